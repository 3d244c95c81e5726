"""The ten operators against brute force on small, awkward inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import (
    decontaminate,
    html_text,
    license_rules,
    line_quality,
    line_spread,
    near_dups,
    packing,
    suffix_dedup,
    token_files,
    tokens,
    toxicity,
)

WORD = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et".split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORD[i]}{j}" for i, j in zip(rng.integers(0, len(WORD), n), rng.integers(0, 400, n)))


LONG = sentence(1, 300)
TEXTS = [
    (1, LONG),
    (2, LONG),
    (3, LONG.replace("lorem", "LOREM", 3)),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, "one"),
    (8, "one"),
    (9, "ab " * 200),
    (10, sentence(2, 40) + "\n" + LONG[200:900] + "\n" + sentence(3, 40)),
    (11, sentence(4, 2000)),
    (12, "ümläut ß 日本語 😀 " * 30),
    (13, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
    (14, sentence(5, 60) + "\n\n" + sentence(5, 60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", 0, "x") for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string"
    ).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_token_files(spark, docs, nothing, tmp_path):
    path = tokens.default_vocabulary("word_bpe_49k.json")
    manifest = token_files.write_token_files(docs, str(tmp_path / "a"), path, 2)
    got = by_id(token_files.read_token_files(manifest, with_ids=True))
    lib, start = tokens.encoder(path).tokenizer, 0
    for i, t in TEXTS:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert got[i].ids == ids.tolist()
        start += len(ids)
    assert token_files.write_token_files(nothing, str(tmp_path / "b"), path, 2).count() == 0


def test_html_text(spark):
    page = (
        "<html><head><title>T</title></head><body><nav><a>menu</a></nav><article><header>h</header><h1>A &amp; B</h1>"
        "<p>one<br>two   three<p>four<script>x='</p>'</script><div class='comments'>no</div></article>"
        "<footer>f</footer></body></html>"
    )
    plain = "<body><div>shared words that every page of this host has got</div><p>own {} text</p></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, "x", ""), (4, "http://g/1", plain.format("first"))]
    rows.append((5, "http://g/2", plain.format("second")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert got[1].text == "A & B\n\none two three\n\nfour" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == ""
    assert got[4].text == "own first text" and got[5].text == "own second text"
    assert html_text.main_text(df.where("page_id < 0")).count() == 0


def test_line_spread(spark, nothing):
    rows = [(i, f"shared line\nown {i} a\nown {i} b", f"s{i}") for i in range(6)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(line_spread.remove_shared_lines(df, min_sites=6))
    assert got[0].text == "own 0 a\nown 0 b" and got[0].n_removed == 1 and got[9].text is None
    assert sum(r.n_removed for r in line_spread.remove_shared_lines(df, min_sites=7).collect()) == 0
    assert line_spread.remove_shared_lines(nothing).count() == 0


def test_line_spread_takes_all_shared_lines_and_counts_sites_of_copies(spark):
    rows = [(i, f"menu\nimprint\nown {i}", f"s{i}") for i in range(5)] + [(5, "menu\nimprint", "s5")]
    rows += [(10 + i, "copied\n\n Copied ", f"s{i}") for i in range(6)] + [(20, "few", "s0"), (21, "few", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(line_spread.remove_shared_lines(df, min_sites=6))
    sites = {}
    for _, t, s in rows:
        for x in t.split("\n"):
            sites.setdefault(x.strip().lower(), set()).add(s)
    for i, t, _ in rows:
        lines = t.split("\n")
        kept = [x for x in lines if not x.strip() or len(sites[x.strip().lower()]) < 6]
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert got[0].text == "own 0" and got[5].text == "" and got[10].text == "" and got[20].text == "few"


def test_line_spread_keeps_columns_of_any_name_and_every_row(spark):
    rows = [(i % 5, f"menu\nown {i}", f"s{i}", "g", "k", i) for i in range(7)] + [(None, "menu\nx", "s9", "g", "k", 8)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, gone string, _key string, n_lines int")
    got = line_spread.remove_shared_lines(df, min_sites=8).collect()
    assert len(got) == 9 and all((r.gone, r._key, r.n_lines, r.n_removed) == ("g", "k", 2, 1) for r in got)
    assert sorted(r.text for r in got) == sorted(["own %d" % i for i in range(7)] + ["x", "x"])
    long = "\n".join(["menu", "y"] * 20_000)
    got = line_spread.remove_shared_lines(df.unionByName(df.limit(1).withColumn("text", F.lit(long))), min_sites=8)
    assert [r.text for r in got.collect() if r.n_removed > 1] == ["\n".join(["y"] * 20_000)]


def test_licenses(docs, nothing):
    got = by_id(license_rules.scan_licenses(docs))
    assert got[13].base_labels == "cc-by-nc,mit" and got[13].n_base == 2 and got[13].score == 1.0
    assert got[13].labels == "cc-by-nc,mit" and (got[13].first_word, got[13].last_word) == (1, 7)
    assert got[4].n_words == 0 and got[4].labels == "" and got[4].first_word is None
    assert len(license_rules.rules()) > 300
    assert license_rules.scan_licenses(nothing).count() == 0


LICENSE_TEXTS = [
    ("Mit Licence", "mit", 0.6),
    ("WTFPL", "wtfpl", 0.6),
    ("odbl", "odbl", 0.6),
    ("the FreeBSD License", "bsd-2-clause", 0.6),
    ("licenced under the ISC license", "isc", 1.0),
    ("governed by the zlib license", "zlib", 0.9),
    ("subject to the zlib licence", "zlib", 0.7),
    ("SPDX-License-Identifier: MIT", "mit", 1.0),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2", 1.0),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause", 1.0),
    ("SPDX-License-Identifier: (GPL-2.0-or-later OR MIT)", "gpl-2.0,mit", 1.0),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa", 1.0),
    ("http://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa", 1.0),
    ("released under GPLv3", "gpl-3.0", 1.0),
    ("my mitten is under the table, see the license", "", 0.0),
]


def test_licenses_of_each_wording(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(LICENSE_TEXTS)]
    got = by_id(license_rules.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(t, got[i].labels, got[i].score) for i, (t, _, _) in enumerate(LICENSE_TEXTS)] == LICENSE_TEXTS


def test_every_alternative_of_a_rule_passes_its_gate():
    for r in license_rules.rules():
        expression = r.pattern.pattern.removeprefix("(?:^|(?<= ))").removesuffix("(?= |$)")
        texts = {x.replace("\0", "4") for x in license_rules._strings(license_rules._parser.parse(expression))}
        for x in texts:
            assert r.pattern.fullmatch(x), (r.name, x)
            assert any(s <= set(x.split()) for s in r.keywords), (r.name, x)


def test_every_rule_finds_a_text_of_its_own():
    """A text of each rule, through the whole scan: it has the rule's label, or another's that contains its match."""
    scanner = license_rules._Scanner()
    texts, rules = [], license_rules.rules()
    for r in rules:
        expression = r.pattern.pattern.removeprefix("(?:^|(?<= ))").removesuffix("(?= |$)")
        every = license_rules._strings(license_rules._parser.parse(expression))
        texts.append("Some words, " + max(every, key=len).replace("\0", "4").replace(" ", "-") + ". More")
    data, offsets = license_rules.kernel.utf8(license_rules.pa.array(texts))
    *_, labels, score = scanner.batch(data, offsets)
    own = [r.label in got for r, got in zip(rules, labels)]
    assert all(labels) and (score > 0).all() and np.mean(own) > 0.97
    assert len({r.pattern.pattern for r in rules}) == len(rules) and len(license_rules.SIGNATURES) > 140


def test_base_places_against_words(spark):
    rng = np.random.default_rng(12)
    parts = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "under the mit license", "CC-BY-NC", "é", "x"]
    texts = [" ,.-\n"[rng.integers(5)].join(rng.choice(parts, rng.integers(0, 60))) for _ in range(300)] + [None, "", "apache license, version 2"]
    got = by_id(license_rules.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in license_rules.BASE:
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert labels <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1


def brute_removed(texts):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 2000])
def test_suffix_dedup(docs, nothing, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    got = by_id(suffix_dedup.remove_repeats(docs))
    for i, want in brute_removed(TEXTS).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG), (1, None)], "doc_id long, text string")
    assert sorted(r.n_removed > 0 for r in suffix_dedup.remove_repeats(df).collect()) == [False, False, True, True]
    assert near_dups.near_duplicates(df).count() == 4


def test_toxicity(spark, nothing):
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, sentence(1000 + i, 60) + (" vile awful" if bad else ""), "en"))
        labels.append((i, 1, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(df, lab))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    assert toxicity.toxicity(nothing, lab).count() == 0
    assert toxicity.toxicity(df, lab.where("toxic = 0")).where("predicted = 1").count() == 0


def test_line_quality(docs, nothing):
    got = by_id(line_quality.line_quality(docs))
    for i, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams, covered = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert line_quality.line_quality(nothing).count() == 0


def test_line_quality_removes_lines_of_an_ordinary_host(spark):
    menu, notice = sentence(80, 40), sentence(81, 60)
    rows = [(i, f"{menu}\n{sentence(100 + i, 90)}\n{menu}", "h") for i in range(11)]
    rows += [(11, f"{sentence(111, 20)}\n{menu}", "h"), (12, menu, "other")]
    rows += [(20 + i, f"{notice}\n{sentence(200 + i, 5)}", "g") for i in range(10)] + [(30, notice + "\nx", "k")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in line_quality.line_quality(df).collect():
        got.setdefault(r.doc_id, r)
    for i in range(11):  # 12 texts of the host have the menu: 80 of 170 words go, more than half are left
        assert (got[i].shared_lines, got[i].n_shared_words, got[i].kept) == ([0, 2], 80, True)
    assert (got[11].shared_lines, got[11].n_shared_words) == ([1], 40)
    assert not got[11].base_failed and not got[11].kept  # 20 of 60 words are left
    assert got[12].shared_lines == []
    assert all(got[20 + i].shared_lines == [] and got[20 + i].kept for i in range(10))  # ten texts: not above
    text = df.where("doc_id = 11").select(line_quality.without_lines("text", F.array(F.lit(1)))).first()[0]
    assert text == sentence(111, 20)


def test_decontaminate(spark, nothing):
    item = sentence(50, 40)
    edited = item.split()
    edited[7] = "changed"
    del edited[20]
    rows = [(1, sentence(51, 50) + " " + item), (2, " ".join(edited)), (3, sentence(52, 200)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7].score == 1.0 and 0.8 < got[2, 7].score < 1
    assert (got[1, 7].first_word, got[1, 7].last_word) == (50, 89)
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("item_id < 0")).count() == 0


def test_short_items_match_exactly(spark):
    df = spark.createDataFrame([(1, "x Alpha beta y alpha beta"), (2, "beta alpha"), (2, "gamma"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha, BETA"), (8, "gamma"), (9, "alpha beta"), (9, "!"), (10, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(1, 7, 1.0, 1, 2), (1, 9, 1.0, 1, 2), (2, 8, 1.0, 0, 0)]


@pytest.mark.parametrize("rate,least", [(0.1, 1.0), (0.2, 0.99), (0.3, 0.98)])
def test_edited_copies_are_found_as_by_aligning_all(rate, least):
    """Of copies with words replaced, dropped or added, those that align by half or more, by every pair's alignment."""
    rng = np.random.default_rng(8)
    items = [sentence(400 + i, 16 + 2 * i) for i in range(20)]

    def edited(text):
        out = []
        for w in text.split():
            kind = rng.integers(3) if rng.random() < rate else 3
            out += {0: ["new%d" % rng.integers(999)], 1: [], 2: [w, "more"], 3: [w]}[int(kind)]
        return " ".join(out)

    texts = [f"{sentence(9000 + i, 20)} {edited(items[i % 20])}" for i in range(200)]
    all_ = decontaminate.Items(list(range(20)), items, 3)
    seeds = all_.seeds(np.ones(len(all_.keys), np.int64), 2)
    column = decontaminate.pa.array(texts)
    ((_, _, w, words, grams, owner),) = decontaminate.grams_of(column, 3)
    found = {(int(r), int(i)) for r, i in decontaminate.matches(seeds, words, w.first, grams, owner, 0.5)[:, :2]}
    want = set()
    for i in range(20):
        begin, end = np.full(200, all_.first[i]), np.full(200, all_.first[i + 1])
        best = decontaminate.align(
            decontaminate._padded(all_.words, begin, end, 0), decontaminate._padded(words, w.first[:-1], w.first[1:], 1)
        )[0]
        want |= {(int(r), i) for r in np.flatnonzero(best / (2 * (end - begin)) >= 0.5)}
    assert found <= want and len(want) > 100 and len(found) >= least * len(want)


def test_packing(docs, nothing):
    path = tokens.default_vocabulary("byte_bpe_50k.json")
    placed = packing.pack_documents(docs, path, 2, size=64, with_ids=True)
    rows = placed.collect()
    for i, t in TEXTS:
        mine = sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == i)
        ids = np.array(tokens.encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert b"".join(m[3] for m in mine) == ids.tobytes()
        assert all(m[2] == 64 for m in mine[1:])
    for s in packing.sequences(placed).collect():
        assert s.n_tokens <= 64 and len(s.ids) == 4 * s.n_tokens
    assert packing.pack_documents(nothing, path, 2).count() == 0


def test_best_fit_closes_the_fullest():
    p = packing.BestFit(10, open_bins=2)
    assert [p.place(n) for n in (6, 5, 3, 9, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 5)]


def test_near_duplicates(spark, nothing):
    base = sentence(60, 120).split()
    near = base[:60] + ["x"] + base[61:]
    far = base[:60] + sentence(61, 60).split()
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (6, "a b"), (7, "A  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: r.component_id for i, r in by_id(near_dups.near_duplicates(df, words=3, percent=85)).items()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    assert near_dups.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("members,grams", [(8000, 1_500_000), (7, 1_500_000), (8000, 600)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, members, grams):
    """Groups of copies at many similarities, ties at the limit, short texts, repeated rows; all pairs compared by sets."""
    monkeypatch.setattr(near_dups, "UNIT_MEMBERS", members)
    monkeypatch.setattr(near_dups, "UNIT_GRAMS", grams)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        base = sentence(700 + g, 40 + 5 * g).split()
        for _ in range(8):
            copy = list(base)
            for k in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[k] = f"z{rng.integers(99)}"
            rows.append(" ".join(copy))
    rows += ["a b", "A b", "a", "", None, " \n", "a b c", "a b c d", rows[0], rows[0] + " end", "a  b"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    sets = []
    for t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append(set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if x == b else x for x in group]
    got = by_id(near_dups.near_duplicates(df, words=3, percent=85))
    assert [got[i].component_id for i in range(len(rows))] == group
    assert [(got[i].n_shingles, got[i].kept) for i in range(len(rows))] == [(len(s), g == i) for i, (s, g) in enumerate(zip(sets, group))]
    assert len(set(group)) < 80  # many rows are linked


def test_spanning_links_by_sorting_equals_bits(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 100)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 1 << 62, k)])) for k in range(0, 30, 3)]
    values = np.concatenate(sets).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sk = (near_dups.kernel.mix(near_dups.sketch(values, owner, len(sets))) & np.uint64(255)).astype(np.uint8)
    a = near_dups.spanning_links(values, first, sk, np.zeros(len(sets)), 85)
    monkeypatch.setattr(near_dups, "BITS", 0)
    assert a == near_dups.spanning_links(values, first, sk, np.zeros(len(sets)), 85) and a
