"""Retrieval by stored indexes against comparing all pairs, and what tasks pass on."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.operators import cells as X
from lorewell.operators import postings as P
from lorewell.operators import retrieval as R

BLOCKS = "article_key string, ordinal int, block_type string, text string"


def blocks(spark, n, seed, common=("the", "of", "and", "to")):
    r = random.Random(seed)
    rows = []
    for a in range(n):
        for o in range(r.randrange(1, 6)):
            words = [w for w in common if r.random() < 0.9] + [f"w{min(int(r.expovariate(0.03)), 300)}" for _ in range(r.randrange(0, 25))]
            rows.append((f"raw/{a}", o, r.choice(["idea_blocks", "summary", "main_content", "failure_modes", "title"]), " ".join(words)))
    return spark.createDataFrame(rows, BLOCKS).repartition(5)


def queries(spark, n, seed, common=("the", "of", "and", "to")):
    r = random.Random(seed)
    rows = [(q, " ".join([*common, *(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 14)))])) for q in range(n)]
    rows += [(n, ""), (n + 1, "unknown words"), (n + 2, "the"), (n + 3, None)]
    return spark.createDataFrame(rows, "query_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "article_key", "ordinal", "block_type", "score").collect())


def by_hand(given, asked, limit, per_article):
    """Every pair scored, in plain Python."""
    import re

    out = []
    held = [(b.article_key, b.ordinal, b.block_type, set(re.findall("[a-z0-9_]+", b.text))) for b in given.collect()]
    for q in asked.collect():
        mine = set(re.findall("[a-z0-9_]+", q.text or ""))
        scored = []
        for a, o, t, words in held:
            if mine & words:
                score = R._rounded(len(mine & words) / len(mine) + R.TYPE_BONUS.get(t, 0.0)) / 1e6
                scored.append((-R._rounded(score + R.RANK_BONUS.get(t, 0.0)), a, o, t, score))
        taken, of = [], {}
        for x in sorted(scored):
            of[x[1]] = of.get(x[1], 0) + 1
            if not per_article or of[x[1]] <= per_article:
                taken.append(x)
        out += [(q.query_id, k + 1, a, o, t, s) for k, (_, a, o, t, s) in enumerate(taken[:limit])]
    return sorted(out)


@pytest.mark.parametrize("limit, per_article, seed", [(16, 3, 1), (5, 1, 2), (8, None, 3)])
def test_keywords_by_tasks_and_by_postings(spark, tmp_path, limit, per_article, seed):
    given, asked = blocks(spark, 60, seed), queries(spark, 12, seed)
    want = by_hand(given, asked, limit, per_article)
    assert rows(R.keyword_top(given, asked, limit, per_article)) == want
    P.write_postings(given, str(tmp_path / "p"), parts=8)
    assert rows(P.search(spark, str(tmp_path / "p"), asked, limit, per_article)) == want


def test_postings_of_common_words_are_not_read(spark, tmp_path):
    given = blocks(spark, 400, 9)
    asked = spark.createDataFrame(
        [(k, given.where("length(text) > 90").orderBy("article_key", "ordinal").collect()[k].text) for k in range(5)], "query_id long, text string"
    )
    P.write_postings(given, str(tmp_path / "p"), parts=8)
    got, read = P.search(spark, str(tmp_path / "p"), asked, 3, count=True)
    assert rows(got) == by_hand(given, asked, 3, 3)
    counts = {r.token: r.n for r in spark.read.parquet(str(tmp_path / "p" / "counts")).collect()}
    all_ = P.asked_tokens(spark, str(tmp_path / "p"), asked).select("token").collect()
    assert 0 < read < 0.7 * sum(counts[r.token] for r in all_)


def test_tasks_pass_on_bounded_rows(spark):
    given = blocks(spark, 300, 4).repartition(2)
    asked = queries(spark, 6, 4)
    with_tokens = given.select("article_key", "ordinal", "block_type", R._hashes(F.col("text")).alias("tokens"))
    (shared,) = list(R._asked_blocks(asked))
    schema = "query_id long, article_key string, ordinal int, block_type string, overlap long, n long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # many batches a task
    try:
        passed = with_tokens.mapInArrow(R._matching(shared, 4, 2), schema).groupBy("query_id").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r["count"] for r in passed) <= 2 * 4 * 2


def test_a_query_of_20000_words(spark):
    text = " ".join(f"w{k}" for k in range(20_000))
    given = spark.createDataFrame([("a", 0, "summary", "w1 w2 w3"), ("b", 0, "title", text), ("c", 0, "title", "none")], BLOCKS)
    asked = spark.createDataFrame([(1, text), (2, "w2")], "query_id long, text string")
    began = time.time()
    assert rows(R.keyword_top(given, asked, 5)) == by_hand(given, asked, 5, 3)
    assert time.time() - began < 60


def vectors(n, d, seed, clusters=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, d)) * 3
    x = centres[r.integers(0, clusters, n)] + r.normal(size=(n, d)) * 0.4
    x[3] = 0
    x[10:14] = x[9]
    return x.astype(np.float32)


def frame(spark, x, name, first=0, extra=()):
    data = [(first + k, v.tolist()) for k, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, f"{name} long, embedding array<float>").repartition(6)


def nearest(x, q, n):
    unit = R.unit_rows(x.astype(float))
    out = []
    for k, v in enumerate(R.unit_rows(q.astype(float))):
        s = np.round(np.maximum(unit @ v, 0), 6)
        for rank, i in enumerate(np.lexsort((np.arange(len(x)), -s))[:n]):
            out.append((k, int(i), float(s[i]), rank + 1))
    return sorted(out)


def near_rows(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("seed, n", [(0, 5), (1, 1), (2, 30)])
def test_vectors_by_tasks_and_by_cells(spark, tmp_path, seed, n):
    x = vectors(600, 8, seed)
    q = np.concatenate([x[:20], -x[20:23], np.zeros((1, 8), np.float32)])
    odd = [(9000, None), (9001, [1.0, 2.0]), (9002, [])]
    index = frame(spark, x, "id", extra=odd)
    asked = frame(spark, q, "query_id", extra=[(500, None), (501, [1.0])])
    want = nearest(x, q, n)
    assert near_rows(R.vector_scores(index, asked.where("size(embedding) = 8 OR embedding IS NULL"), n)) == want
    X.write_cells(index, str(tmp_path / "c"), 24)
    got, compared = X.search(spark, str(tmp_path / "c"), asked, n, count=True)
    assert near_rows(got) == want
    if n < 30:
        assert compared < 0.6 * len(x) * len(q)  # groups of vectors are passed over


def test_cells_without_structure_and_without_rows(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(300, 16)).astype(np.float32)
    X.write_cells(frame(spark, x, "id"), str(tmp_path / "c"), 10, sample=50)
    assert near_rows(X.search(spark, str(tmp_path / "c"), frame(spark, x[:9], "query_id"), 4)) == nearest(x, x[:9], 4)
    X.write_cells(frame(spark, x, "id").limit(0), str(tmp_path / "e"), 10)
    assert X.search(spark, str(tmp_path / "e"), frame(spark, x[:9], "query_id"), 4).count() == 0
    assert X.search(spark, str(tmp_path / "c"), frame(spark, x[:0], "query_id"), 4).count() == 0


def test_vector_tasks_pass_on_n_a_query(spark):
    x = vectors(3000, 4, 7)
    index = frame(spark, x, "id").repartition(2)
    asked = frame(spark, x[:15], "query_id").collect()
    shared = spark.sparkContext.broadcast(R.unit_queries(asked))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        passed = index.mapInArrow(R._nearest(shared, 6), "query_id long, id long, score double").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert passed <= 6 * 15 * 2


class Shared:
    """What a broadcast gives in a task."""

    def __init__(self, value):
        self.value = value


def test_memory_of_a_task_does_not_grow_with_pairs_of_queries_and_rows():
    r = np.random.default_rng(3)
    tokens = [[*range(8), *(100 + r.integers(0, 900, 4)).tolist()] for _ in range(2000)]
    asked = R._Asked(np.arange(2000), [sorted(set(t)) for t in tokens])
    given = [sorted({*range(8), *(100 + r.integers(0, 900, 10)).tolist()}) for _ in range(5000)]
    columns = {
        "article_key": [f"raw/{k // 4}" for k in range(5000)], "ordinal": pa.array(np.arange(5000) % 4, pa.int32()), "block_type": ["summary"] * 5000,
        "slug": [f"s{k}" for k in range(5000)], "memory": r.random(5000), "tokens": pa.array(given, pa.list_(pa.int64())),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    for run in (R._matching(Shared(asked), 4, 2), R._matching_concepts(Shared(asked), 3)):
        tracemalloc.start()
        n = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n >= 3 * 2000
        assert peak < 200e6  # all pairs' counts: over a gigabyte


@pytest.mark.parametrize("limit, per_article", [(6, 2), (3, None)])
def test_first_limits_and_small_chunks_give_the_same_blocks(spark, monkeypatch, limit, per_article):
    monkeypatch.setattr(R, "MANY_QUERIES", 1)
    monkeypatch.setattr(R, "FIRST_ARTICLES", 3)
    given, asked = blocks(spark, 80, 6), queries(spark, 25, 7)
    assert rows(R.keyword_top(given, asked, limit, per_article)) == by_hand(given, asked, limit, per_article)
    monkeypatch.setattr(R, "CHUNK_ROWS", 7)
    monkeypatch.setattr(R, "CHUNK_TOKENS", 60)
    batch = pa.RecordBatch.from_pydict({"tokens": pa.array([list(range(k % 90)) for k in range(100)], pa.list_(pa.int64())), "k": list(range(100))})
    parts = list(R._chunks(iter([batch.slice(0, 50), batch.slice(50, 0), batch.slice(50)])))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(100))
    assert max(p.num_rows for p in parts) <= 7
    assert all(p.num_rows == 1 or len(p["tokens"].flatten()) <= 60 for p in parts)


def test_tasks_keep_the_best_over_small_chunks(monkeypatch):
    monkeypatch.setattr(R, "CHUNK_ROWS", 7)
    monkeypatch.setattr(R, "CHUNK_TOKENS", 40)
    r = np.random.default_rng(8)
    given = [sorted(set(r.integers(0, 30, r.integers(0, 12)).tolist())) for _ in range(200)]
    asked = [sorted(set(r.integers(0, 33, r.integers(0, 9)).tolist())) for _ in range(40)]
    # names repeat, within chunks too
    slug, memory = [f"s{k}" for k in r.integers(0, 60, 200)], (r.integers(0, 9, 200) / 7).tolist()
    batch = pa.RecordBatch.from_pydict({
        "slug": slug, "memory": memory, "article_key": slug, "ordinal": pa.array(range(200), pa.int32()), "block_type": ["title", "summary"] * 100,
        "tokens": pa.array(given, pa.list_(pa.int64())),
    })
    shared = Shared(R._Asked(np.arange(40), asked))
    concepts = [tuple(x.values()) for p in R._matching_concepts(shared, 3)(iter([batch])) for x in p.to_pylist()]
    found = [x for p in R._matching(shared, 4, 2)(iter([batch])) for x in p.to_pylist()]
    for q, mine in enumerate(asked):
        n = [len(set(mine) & set(g)) for g in given]
        best: dict = {}
        for k in range(200):
            if n[k]:
                best[slug[k]] = max(best.get(slug[k], -1), R._rounded(n[k] + 2.0 * memory[k]))
        want = sorted(((-v, s) for s, v in best.items()))[:3]
        got: dict = {}
        for _, s, shared_, m in (x for x in concepts if x[0] == q):
            got[s] = max(got.get(s, -1), R._rounded(shared_ + 2.0 * m))
        assert sorted(((-v, s) for s, v in got.items()))[:3] == want
        taken, of = [], {}
        for _, s, k in sorted((-rank(mine, n[k], k), slug[k], k) for k in range(200) if n[k]):
            of[s] = of.get(s, 0) + 1
            if of[s] <= 2:
                taken.append(k)
        assert set(taken[:4]) <= {x["ordinal"] for x in found if x["query_id"] == q}


def rank(mine, n, k):
    bonus = R.TYPE_BONUS["summary"] if k % 2 else 0.0
    return R._rounded(R._rounded(n / len(mine) + bonus) / 1e6)
