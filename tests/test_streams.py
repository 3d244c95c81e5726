"""The feedback stream over its store: repeats, late rows, batches that run again; last questions of any split of a log."""

import random

from pyspark.sql import functions as F

from lorewell.operators import concepts as C
from lorewell.operators import maintenance as M
from lorewell.sources.store import Store
from lorewell.streaming import feedback

STATE = "slug string, status string, importance double, retrieval_hints array<string>"


def begun(spark, tmp_path, rows, buckets=8):
    store = Store(spark, str(tmp_path / "store"), feedback.STORED, buckets)
    feedback.begin(store, spark.createDataFrame(rows, STATE))
    return store


def state_of(store):
    return {r.slug: (r.status, round(r.importance, 4), r.retrieval_hints) for r in store.read("state").collect()}


def run(spark, tmp_path, store, *parts):
    for part in parts:
        spark.createDataFrame(part, feedback.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(feedback.LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        feedback.stream_feedback(stream, store.root, f"{tmp_path}/check").awaitTermination()


def test_each_row_counts_once_over_batches(spark, tmp_path):
    store = begun(spark, tmp_path, [("c", "stable", 0.98, ["q_one", *[f"h{i}" for i in range(11)]]), ("still", "stable", 0.3, [])])
    rows = [(1, "Q one", ["c", "new"]), (2, "Q two", ["c", "c"]), (1, "Q one", ["c", "new"]), (3, None, None), (4, "Q four", [])]
    run(spark, tmp_path, store, rows[:1], rows[1:], rows[:2])
    got = state_of(store)
    assert got["c"] == ("stable", 1.0, [*[f"h{i}" for i in range(11)], "q_two"])
    assert got["new"] == ("proposed", 0.05, ["q_one"]) and got["still"] == ("stable", 0.3, [])


def test_late_rows_are_taken_when_they_come(spark, tmp_path):
    store = begun(spark, tmp_path, [("c", "stable", 0.0, [])])
    run(spark, tmp_path, store, [(10, "Ten", ["c"]), (9, "Nine", ["c"])], [(2, "Two", ["c"]), (10, "Ten", ["c"])])
    assert state_of(store)["c"] == ("stable", 0.15, ["nine", "ten", "two"])


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = begun(spark, tmp_path, [("c", "stable", 0.0, [])])
    batch = spark.createDataFrame([(1, "Q", ["c"])], feedback.LOG)
    feedback.apply_batch(store, batch, "stream#0")
    feedback.apply_batch(store, batch, "stream#0")
    assert state_of(store)["c"][1] == 0.05
    feedback.apply_batch(store, spark.createDataFrame([(2, "R", ["c"])], feedback.LOG), "stream#1")
    feedback.apply_batch(store, batch, "stream#0")
    assert state_of(store)["c"] == ("stable", 0.1, ["q", "r"])
    feedback.apply_batch(store, spark.createDataFrame([(3, "S", ["c"])], feedback.LOG), "other#0")  # another stream's numbers are its own
    assert state_of(store)["c"][1] == 0.15


def test_a_batch_reads_and_writes_what_it_cites(spark, tmp_path):
    store = begun(spark, tmp_path, [(f"s{i}", "stable", 0.1, []) for i in range(200)], buckets=64)
    before = set(store.read("state").inputFiles())
    feedback.apply_batch(store, spark.createDataFrame([(1, "Q", ["s7"])], feedback.LOG), "x#0")
    after = set(store.read("state").inputFiles())
    assert len(after - before) == 1 and len(before - after) == 1 and state_of(store)["s7"][1] == 0.15
    assert sum(v[1] == 0.1 for v in state_of(store).values()) == 199


def test_batches_in_order_are_one_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"question {i}", sorted({f"c{r.randrange(5)}" for _ in range(2)})) for i in range(60)]
    state = [("c0", "stable", 0.2, ["old"]), ("c1", "proposed", 0.99, [])]
    store = begun(spark, tmp_path, state)
    for k, (a, b) in enumerate([(0, 7), (7, 8), (8, 40), (40, 60)]):
        feedback.apply_batch(store, spark.createDataFrame(rows[a:b], feedback.LOG), f"x#{k}")
    whole = C.apply_feedback(spark.createDataFrame(rows, feedback.LOG), spark.createDataFrame(state, STATE))
    assert state_of(store) == {r.slug: (r.status, round(r.importance, 4), r.retrieval_hints) for r in whole.collect()}


def test_ids_are_forgotten_past_the_watermark(spark, tmp_path):
    store = begun(spark, tmp_path, [("c", "stable", 0.0, [])])
    schema = feedback.LOG + ", at timestamp"
    for n, (i, day) in enumerate([(1, "2026-01-01"), (1, "2026-01-02"), (2, "2026-03-01")]):
        row = spark.createDataFrame([(i, f"q{n}", ["c"], day)], feedback.LOG + ", at string").withColumn("at", F.to_timestamp("at"))
        row.coalesce(1).write.mode("append").parquet(f"{tmp_path}/timed")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/timed")
    feedback.stream_feedback(stream, store.root, f"{tmp_path}/timed-check", time_col="at", late="2 days").awaitTermination()
    assert state_of(store)["c"][1] == 0.1


def test_last_questions_of_any_split(spark, tmp_path):
    r = random.Random(5)
    schema = "query_id long, query string, cited_concepts array<string>"
    rows = [(i, f"q{i}", [f"c{r.randrange(4)}", f"c{r.randrange(4)}"]) for i in range(40)] + [(41, "none", None)]
    want = {r.slug: r.queries for r in M.query_improvements(spark.createDataFrame([(i, q, sorted(set(c or []))) for i, q, c in rows], schema)).collect()}
    for turn in range(2):
        r.shuffle(rows)
        store = Store(spark, str(tmp_path / f"last{turn}"), M.STORED, 4)
        for part in (rows[:9], rows[9:30], [], rows[5:12], rows[30:]):
            out = M.keep_last(store, spark.createDataFrame(part, schema))
        assert {r.slug: r.queries for r in M.questions(out).collect()} == want
