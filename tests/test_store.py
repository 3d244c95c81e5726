"""Stored tables: buckets that stay, commits that are lost, and an index kept over several runs."""

import pytest
from pyspark.sql import functions as F

from lorewell.operators import indexing as X
from lorewell.sources.store import Change, Store

ROWS = "article_key string, v int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def store(spark, tmp_path, **kw):
    return Store(spark, str(tmp_path / "s"), {"t": "article_key", "m": "article_key"}, **kw)


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def test_commits_touch_their_buckets_alone(spark, tmp_path):
    s = store(spark, tmp_path, buckets=16)
    assert s.read("t") is None and s.versions() == []
    s.commit({"t": Change(frame(spark, *[(f"k{i}", i) for i in range(100)])), "m": Change(frame(spark, ("all", 1)))})
    before = set(s.read("t").inputFiles())
    s.commit({"t": Change(frame(spark, ("k7", 700), ("k7", 701), ("new", 1)), None)}, tag="second")
    assert store(spark, tmp_path).buckets == 16  # the first commit's number holds
    want = sorted([(f"k{i}", i) for i in range(100) if i != 7] + [("k7", 700), ("k7", 701), ("new", 1)])
    assert rows(s.read("t")) == want and rows(s.read("m")) == [("all", 1)] and s.tag() == "second"
    after = set(s.read("t").inputFiles())
    touched = {r.b for r in frame(spark, ("k7", 0), ("new", 0)).select(s.bucket(F.col("article_key")).alias("b")).collect()}
    assert 14 <= len(before & after) == 16 - len(touched) and len(after - before) == len(touched)
    # rows go by their keys, to the last one
    s.commit({"t": Change(frame(spark), frame(spark, *[(f"k{i}", 0) for i in range(100)]))})
    assert rows(s.read("t")) == [("new", 1)]
    s.commit({"t": Change(frame(spark), frame(spark, ("new", 0), ("unknown", 0)))})
    assert rows(s.read("t")) == [] and s.read("t").columns == ["article_key", "v"]
    s.commit({"t": Change(spark.createDataFrame([(None, 1), ("a", 2)], ROWS))})
    assert len(rows(s.read("t").fillna("", ["article_key"]))) == 2


def test_a_commit_that_is_lost_leaves_the_version_before(spark, tmp_path):
    s = store(spark, tmp_path, buckets=4)
    s.commit({"t": Change(frame(spark, ("a", 1))), "m": Change(frame(spark, ("a", 1)))})
    s.write("t", Change(frame(spark, ("a", 2))), "run-lost")  # and then the driver is gone
    again = store(spark, tmp_path)
    assert rows(again.read("t")) == [("a", 1)] and rows(again.read("m")) == [("a", 1)]
    again.commit({"t": Change(frame(spark, ("a", 3))), "m": Change(frame(spark, ("a", 3)))})
    assert rows(again.read("t")) == rows(again.read("m")) == [("a", 3)]
    assert not (tmp_path / "s" / "t" / "run-lost").exists()
    with pytest.raises(RuntimeError):
        again.publish(again.pointer())


def test_old_versions_go_and_new_columns_come(spark, tmp_path):
    s = store(spark, tmp_path, buckets=2)
    for k in range(6):
        s.commit({"t": Change(frame(spark, ("a", k), (f"b{k}", k)))})
    assert s.versions() == [4, 5, 6] and rows(s.read("t", version=4).where("article_key = 'a'")) == [("a", 3)]
    s.commit({"t": Change(spark.createDataFrame([("c", 1, 0.5)], ROWS + ", w double"))})
    assert s.read("t").where("w IS NULL").count() == 7 and s.read("t").where("w = 0.5").count() == 1


NOTE = "article_key string, status string, content string, summary string, main_content string"
EMPTY = "title string, slug string, status string, sources array<string>, synthesis string"
SUMMARY = "article_key string, content_type string, takeaway string, top_idea_blocks array<string>"
STATE = "slug string, confidence double, importance double, freshness double, source_count int"


def indexed(spark, s, texts, concepts=(), fail=(), **kw):
    notes = spark.createDataFrame([(f"raw/{k}", "reviewed", t, t, f"paragraph of {t} " * 5) for k, t in texts.items()], NOTE)
    calls = spark.sparkContext.accumulator(0)

    def embed(batch):
        if any(f in t for t in batch for f in fail):
            raise ValueError("no")
        calls.add(len(batch))
        return [[float(len(t))] for t in batch]

    pages = spark.createDataFrame([(c, c, "stable", [], t) for c, t in concepts], EMPTY)
    out = X.index_into(s, notes, pages, spark.createDataFrame([], SUMMARY), spark.createDataFrame([], STATE), embed, **kw)
    return out, calls.value


def test_an_index_over_several_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "index"), X.STORED, buckets=32)
    texts = {f"a{i}": f"text {i}" for i in range(20)}
    out, calls = indexed(spark, s, texts, [("c", "first"), ("d", "other")])
    n = out.index.count()
    assert calls == n and out.index.where("kb_layer = 'wiki_concept'").count() == 2 and out.manifest.count() == 20
    assert tuple(out.summary.first()) == (20, 20, 0, 0)
    kept = set(out.index.inputFiles())
    # nothing changed: nothing is embedded or written
    out, calls = indexed(spark, s, texts, [("c", "first"), ("d", "other")])
    assert calls == 0 and set(out.index.inputFiles()) == kept and s.versions() == [1]
    # an article and a page change, a new article fails
    texts |= {"a3": "changed", "bad": "poison"}
    out, calls = indexed(spark, s, texts, [("c", "second"), ("d", "other")], fail=["poison"])
    assert s.versions() == [1, 2] and 0 < len(set(out.index.inputFiles()) - kept) <= 2
    assert [r.key for r in out.failures.collect()] == ["raw/bad"] and out.manifest.count() == 20
    assert out.index.where("article_key = 'raw/a3' AND text LIKE '%changed%'").count() >= 1
    assert out.index.where("text LIKE '%text 3%'").count() == 0
    assert [r.text for r in out.index.where("slug = 'c'").select("text").collect()] == ["second"]
    assert tuple(out.summary.first()) == (21, 1, 19, 1)
    # it is taken again, and what is gone goes
    texts = {k: t for k, t in texts.items() if k != "a5"}
    out, calls = indexed(spark, s, texts, [("c", "second")], present_only=True)
    assert {r.article_key for r in out.manifest.collect()} == {f"raw/{k}" for k in texts}
    assert {r.article_key for r in out.index.select("article_key").distinct().collect()} == {f"raw/{k}" for k in texts} | {"wiki/concepts/c.md"}
    # forced: all are embedded again
    out, calls = indexed(spark, s, texts, [("c", "second")], force=True)
    assert calls == out.index.count()
