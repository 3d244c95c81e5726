"""Stages of the pipeline on rows whose ids repeat or are null."""

import corpus_pipeline
from test_operators import sentence


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)


def _kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_near_dedup_decides_by_row(spark):
    copied, other, lone = sentence(300, 80), sentence(301, 80), sentence(302, 80)
    rows = [(1, copied), (1, copied), (2, copied), (1, other), (None, lone), (None, lone), (None, copied), (3, None)]
    docs = _documents(spark, [(i, t, "s", 0) for i, t in rows])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    # the first row in id, text order stands for its group: the null ids go first
    assert _kept(got) == sorted([(None, copied), (None, lone), (1, other), (3, None)], key=repr)


def test_decontamination_decides_by_row(spark, tmp_path):
    item, clean = sentence(310, 40), sentence(311, 80)
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, clean), (1, f"{clean} {item}"), (None, item), (None, clean), (2, item), (3, None), (3, None)]
    got = corpus_pipeline.drop_contaminated(spark, _documents(spark, [(i, t, "s", 0) for i, t in rows]), str(tmp_path))
    assert _kept(got) == sorted([(1, clean), (None, clean), (3, None), (3, None)], key=repr)


WIDE = "doc_id long, text string, source string, n_chars long, _row string, score double, n_lines int, gone string, _key string"


def _wide(spark, rows):
    full = [(i, t, s, len(t or ""), "r", 0.5, 7, "g", "k") for i, t, s in rows]
    return spark.createDataFrame(full, WIDE).repartition(3)


def _tables(spark, folder, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_stage_on_awkward_rows_and_on_none(spark, tmp_path):
    """Clashing names, nulls, repeated rows, empty texts, empty tables: rows and columns stay as the stages say."""
    _tables(spark, tmp_path, [(1, 1, 0)], [(1, None)])
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, None, None), (None, "", "s"), (2, " \n ", "s"), (2, "x", None)]
    docs = _wide(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {r._row for r in got.collect()} == {"r"}
        assert got.count() == (5 if name == "near-dedup" else 6), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert packed.count() == 6 and corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_against_plain_python(spark, tmp_path):
    """All five stages in a row: what each takes out, by plain loops over the documents that the one before kept."""
    rows, labels = [], []
    item = sentence(500, 40)
    for i in range(240):
        toxic = i % 6 == 0
        text = sentence(20_000 + i, 50) + (" vile awful rubbish" if toxic else "")
        rows.append((i, text, f"s{i % 20}"))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + i, f"shared menu line\n{sentence(30_000 + i, 40)}", f"s{i}") for i in range(14)]
    near = sentence(501, 100).split()
    rows += [(400 + i, " ".join(near[: 50 + i] + ["z"] + near[51 + i :]), "s1") for i in range(3)]
    rows += [(500, f"{sentence(502, 30)} {item}", "s1"), (501, None, "s1"), (502, "", "s2")]
    _tables(spark, tmp_path, labels, [(1, item)])
    _documents(spark, [(i, t, s, 0) for i, t, s in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t, _ in rows if "vile" not in (t or "")}
    sites = {}
    for i, t, s in rows:
        for line in set((kept.get(i) or "").split("\n")):
            sites.setdefault(line.strip().lower(), set()).add(s)
    for i, t in kept.items():
        if t is not None:
            kept[i] = "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x.strip().lower()]) < 12)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t in kept.items()}
    for i in sorted(kept):
        for j in sorted(kept):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                kept.pop(j)
    kept = {i: t for i, t in kept.items() if item not in (t or "")}
    assert {r.doc_id for r in got} == set(kept) and len(kept) == 217
    library = corpus_pipeline.tokens.encoder(corpus_pipeline.tokens.default_vocabulary("byte_bpe_50k.json")).tokenizer
    lengths = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in kept} == lengths
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1024
    assert len(by_sequence) <= 1.1 * -(-sum(lengths.values()) // 1024) + 1
