"""Every operator on repeated and null ids, null, empty and long texts, hot groups, and columns with clashing names."""

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
from test_operators import sentence

SCHEMA = "doc_id long, text string, source string, _id string, _t string, _key string, _host string, id string, seed string, score double, n long, gone string"
LONG = " ".join(sentence(k, 500) for k in range(60))
COPY = sentence(70_000, 80)
TEXTS = [(1, COPY)] * 40 + [(None, COPY)] * 3 + [(2, None), (2, None), (None, None), (3, ""), (3, " \n\t"), (4, LONG), (4, LONG), (5, "x" * 60_000), (6, "a"), (6, "b")]
PATH = tokens.default_vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{k % 4}", "c", "c", "c", "c", "c", "c", 0.5, 7, "c") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ids(frame, column="doc_id"):
    return sorted((r[column] for r in frame.collect()), key=lambda x: (x is not None, x))


WANT = sorted((i for i, _ in TEXTS), key=lambda x: (x is not None, x))


def test_token_files(docs, tmp_path):
    out = token_files.read_token_files(token_files.write_token_files(docs, str(tmp_path / "t"), PATH, 2), with_ids=True)
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == WANT  # in the order of id, null first
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    library = tokens.encoder(PATH).tokenizer
    want = sorted((i is not None, i or 0, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in TEXTS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in rows) == want


def test_packing(docs):
    rows = packing.pack_documents(docs, PATH, 2, size=128).collect()
    assert sum(r.piece == 0 for r in rows) == len(TEXTS)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 128


def test_pages(docs):
    pages = docs.withColumn("html", F.concat(F.lit("<article><p>"), "text")).withColumn("url", F.lit("http://h/")).withColumnRenamed("doc_id", "page_id")
    out = html_text.main_text(pages)
    assert ids(out, "page_id") == WANT
    assert sum(r.text == COPY for r in out.collect()) == 43
    bare = html_text.main_text(pages.withColumn("html", F.concat(F.lit("<p>"), "text")))
    assert sum(r.text == COPY for r in bare.collect()) == 43  # equal pages do not delete each other


def test_lines(docs):
    out = line_spread.remove_shared_lines(docs, min_sites=4)
    assert ids(out) == WANT and set(docs.columns) < set(out.columns) and {r._t for r in out.collect()} == {"c"}
    assert sum(r.n_removed for r in out.collect()) == 43 and sum(r.text is None for r in out.collect()) == 3


def test_licences_repeats_and_quality(docs):
    assert ids(license_rules.scan_licenses(docs)) == WANT
    out = suffix_dedup.remove_repeats(docs)
    assert ids(out) == WANT
    # of 43 copies and of the two long texts one stays whole; the run of x loses what starts after its first place
    assert sum(r.n_removed == 0 for r in out.collect() if r.n_bytes == len(COPY)) == 1
    assert sorted(r.n_removed for r in out.collect() if r.n_bytes == len(LONG)) == [0, len(LONG)]
    assert [r.n_removed for r in out.collect() if r.doc_id == 5] == [59_999]
    assert ids(line_quality.line_quality(docs)) == WANT


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert ids(out) == WANT and all(0 <= r.score <= 1 for r in out.collect())
    with pytest.raises(ValueError):
        toxicity.score(docs, toxicity.Model(np.zeros(0, np.uint64), np.zeros((0, 1)), np.zeros(1)))


def test_benchmark(spark, docs):
    items = spark.createDataFrame([(7, COPY), (7, " ".join(LONG.split()[:100])), (None, COPY), (8, None), (9, "")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert len(got) == 43 * 2 + 2 and {r.score for r in got} == {1.0}
    assert sorted({(r.doc_id or 0, r.item_id or 0) for r in got}) == [(0, 0), (0, 7), (1, 0), (1, 7), (4, 7)]


def test_near_duplicates(docs):
    out = near_dups.near_duplicates(docs).collect()
    assert len(out) == len(TEXTS)
    # the groups of copies, the two long ones; every other row alone
    assert sum(r.kept for r in out) == len(TEXTS) - 42 - 1
    assert sum(r.n_shingles == 0 for r in out) == 5
