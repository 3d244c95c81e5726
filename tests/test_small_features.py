"""Statuses in article texts, judges' answers, writers that can run again, and readers of odd input."""

import json
import random

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import compiling as K
from lorewell.operators import extraction as E
from lorewell.operators import ideas as I
from lorewell.operators import ingest as G
from lorewell.operators import notes as N
from lorewell.operators import outputs as O
from lorewell.sources import files, folders


def test_statuses_are_edited_in_texts(spark):
    texts = {
        "line": "---\ntitle: T\nstatus:   raw\n---\n\nstatus: raw stays\n",
        "none": "---\ntitle: No Status Article\ncontent_type: methodology\n\n---\n\nBody\n",
        "bare": "Just plain text, no header.\n",
        "later": "text\nstatus: draft here\n",
        "open": "---\ntitle: no end",
        "still": "---\nstatus: raw\n---\n",
    }
    articles = spark.createDataFrame(list(texts.items()), "article_key string, content string")
    updates = [("line", "reviewed", 1), ("line", "high_value", 2), ("none", "reviewed", 1), ("bare", "rejected", 1), ("later", "reviewed", 1)]
    updates += [("open", "reviewed", 1), ("still", "published", 1), ("gone", "reviewed", 1), ("still", None, 2)]
    out, report = G.edit_status(articles, spark.createDataFrame(updates, "article_key string, status string, place int"))
    got = {r.article_key: r.content for r in out.collect()}
    assert got["line"] == "---\ntitle: T\nstatus:   high_value\n---\n\nstatus: raw stays\n"
    assert got["none"] == "---\ntitle: No Status Article\ncontent_type: methodology\nstatus: reviewed\n---\n\nBody\n"
    assert got["later"] == "text\nstatus: reviewed here\n"
    assert all(got[k] == texts[k] for k in ("bare", "open", "still"))
    said = sorted((r.article_key, r.status or "", r.outcome) for r in report.collect())
    assert said == [
        ("bare", "rejected", "no header"), ("gone", "reviewed", "not found"), ("later", "reviewed", "edited"), ("line", "high_value", "edited"),
        ("line", "reviewed", "superseded"), ("none", "reviewed", "inserted"), ("open", "reviewed", "no header"), ("still", "", "not allowed"),
        ("still", "published", "not allowed"),
    ]


def test_judges_answers(spark):
    two = "### Idea Title\nA\n\n### Idea Title\nB\n"
    good = [{"idea_index": 0, "coherence": 0.8, "actionability": 0.7}, {"coherence": "0.25", "actionability": 9}]
    raws = {
        1: json.dumps(good),
        2: f"```json\n{json.dumps(good)}\n```",
        3: json.dumps(good[:1]),  # too short
        4: json.dumps({"a": 1}),
        5: "not json",
        6: json.dumps([good[0], {"coherence": None, "actionability": 1}]),  # null is no number
        7: json.dumps([good[0], {"actionability": -1}]),  # missing is
        8: json.dumps([good[0], "text"]),
        9: None,
        10: json.dumps([good[0], {"coherence": "high"}]),
    }
    outputs = spark.createDataFrame([(k, two) for k in [*raws, 11]] + [(12, "no ideas")], "output_id long, text string")
    answers = spark.createDataFrame([*raws.items(), (12, json.dumps(good)), (99, json.dumps(good))], "output_id long, raw string")
    got = {r.idea_id: (r.coherence, r.actionability, r.judged) for r in O.judged_ideas(outputs, answers).collect()}
    assert len(got) == 22
    default = (0.5, 0.5, False)
    for k in (1, 2):
        assert (got[f"{k}#0"], got[f"{k}#1"]) == ((0.8, 0.7, True), (0.25, 1.0, True))
    assert (got["7#0"], got["7#1"]) == ((0.8, 0.7, True), (0.5, 0.0, True))
    for k in (3, 4, 5, 6, 8, 9, 10, 11):
        assert got[f"{k}#0"] == got[f"{k}#1"] == default, k


def test_hundredths_are_as_python_rounds(spark):
    r = random.Random(1)
    values = [k / 1000 for k in range(0, 1001)] + [k / 8 for k in range(40)] + [r.random() for _ in range(2000)]
    values += [0.3 * a + 0.35 * b + 0.35 * c for a in (0, 0.2, 0.4, 0.8, 1) for b in (0, 0.25, 0.5, 0.7) for c in (0.1, 0.3, 0.55, 1)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", T.hundredths(F.col("x")).alias("y")).collect()
    assert [(g.x, g.y) for g in got if g.y != round(g.x, 2)] == []


def test_quality_has_two_places(spark):
    scores = spark.createDataFrame([("a", 0.4), ("b", 0.8)], "idea_id string, traceability double")
    judged = spark.createDataFrame([("a", 0.333, 0.777)], "idea_id string, coherence double, actionability double")
    assert {r.idea_id: r.quality for r in I.composite(scores, judged).collect()} == {"a": 0.51, "b": 0.59}


ARTICLE = "article_key string, status string, content_type string, content string"


def test_articles_are_added_and_replaced(spark, tmp_path):
    path = str(tmp_path / "articles")
    one = spark.createDataFrame([("a", "raw", "x", "1"), ("b", "reviewed", "y", "2")], ARTICLE)
    two = spark.createDataFrame([("b", "reviewed", "y", "other"), ("c", "raw", "x", "3"), ("c", "raw", "x", "3")], ARTICLE)
    for _ in range(2):  # a run that is repeated adds nothing
        files.write_articles(one, path)
        files.write_articles(two, path)
    got = lambda: sorted((r.article_key, r.content) for r in spark.read.parquet(path).collect())
    assert got() == [("a", "1"), ("b", "2"), ("c", "3")]
    files.replace_articles(spark.createDataFrame([("a", "raw", "x", "new")], ARTICLE), path)
    assert got() == [("a", "new"), ("b", "2")]  # the folder of raw and x alone


def test_log_rows_are_appended_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "query string, mode string, date string, cited_concepts array<string>"
    first = spark.createDataFrame([("q", "ask", "2026-01-01", ["c"]), ("r", "ask", "2026-01-02", None)], schema)
    files.append_query_log(first, path)
    files.append_query_log(first.unionByName(spark.createDataFrame([("q", "ask", "2026-01-02", ["c"])], schema)), path)
    assert sorted((r.query, str(r.date)) for r in spark.read.parquet(path).collect()) == [("q", "2026-01-01"), ("q", "2026-01-02"), ("r", "2026-01-02")]


def test_pages_manifest_failures_and_reports_as_files(spark, tmp_path):
    assert files.read_pages(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("http://x", "<p>x")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    assert files.read_pages(spark, str(tmp_path / "pages")).first().url == "http://x"
    m = spark.createDataFrame([("a", "h", 2, "raw")], files.MANIFEST)
    files.write_state(m, str(tmp_path / "manifest"))
    assert files.read_state(spark, str(tmp_path / "manifest"), files.MANIFEST).collect() == m.collect()
    files.write_state(m, str(tmp_path / "old"), version="0")
    assert files.read_state(spark, str(tmp_path / "old"), files.MANIFEST).count() == 0
    failures = spark.createDataFrame([("a", "api_error", "x\ty")], "key string, error_class string, error string")
    files.write_failures(failures, str(tmp_path / "failures"))
    assert spark.read.csv(str(tmp_path / "failures"), sep="\t", header=True).first().key == "a"
    files.write_report(failures, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().error == "x\ty"


def test_errors_statuses_and_the_index_page(spark):
    errors = ["Read timed out", "TIMEOUT", "bad JSON", "HTTP 404", "HTTPSConnectionPool", "a request", "else", None, ""]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(errors)], "i int, e string").withColumn("c", G.classify_error(F.col("e")))
    want = ["timeout", "timeout", "json_parse_error", "api_error", "api_error", "api_error", "other", "other", "other"]
    assert [r.c for r in df.orderBy("i").collect()] == want
    notes = spark.createDataFrame([("a", "raw"), ("b", "reviewed"), ("c", None)], "article_key string, status string")
    assert [r.article_key for r in N.filter_status(notes, ["reviewed"]).collect()] == ["b"]
    concepts = spark.createDataFrame(
        [("s2", "B", "stable", "d" * 130), ("s1", "A", "proposed", ""), ("s3", "C", "deprecated", "x"), ("s4", "D", "stable", None)],
        "slug string, title string, status string, definition string",
    )
    assert sorted(tuple(r) for r in K.concept_index(concepts).collect()) == [("s2", "B", "d" * 120), ("s4", "D", "")]


def test_article_folders_by_one_scan(spark, tmp_path):
    for name, article, sidecar in [
        ("a", "text ü", '{"source_url": "http://x", "llm_enriched": true, "image_urls": ["i"]}'), ("empty", "", None), ("bad", "b", "no json"),
        ("none", None, "{}"), ("zero", "z", ""),
    ]:
        folder = tmp_path / "raw" / name
        folder.mkdir(parents=True)
        if article is not None:
            (folder / "article.md").write_text(article)
        if sidecar is not None:
            (folder / "source.json").write_text(sidecar)
    (tmp_path / "raw" / "file.txt").write_text("not a folder")
    (tmp_path / "raw" / "bytes").mkdir()
    (tmp_path / "raw" / "bytes" / "article.md").write_bytes(b"\xff ok")
    got = {r.article_key: r for r in files.read_articles_with_sidecars(spark, str(tmp_path)).collect()}
    assert {k: r.content for k, r in got.items()} == {"a": "text ü", "empty": "", "bad": "b", "zero": "z", "bytes": "\ufffd ok"}
    assert (got["a"].source_url, got["a"].llm_enriched, got["a"].image_urls) == ("http://x", True, ["i"])
    assert all(got[k].source_url is None for k in ("empty", "bad", "zero", "bytes"))
    assert {r.article_key for r in files.read_articles(spark, f"file://{tmp_path}").collect()} == set(got)
    assert folders.read_folders(spark, str(tmp_path), folders=2).rdd.getNumPartitions() == 3
    assert files.read_articles_with_sidecars(spark, str(tmp_path / "missing")).count() == 0
    many = files.read_articles(spark, str(tmp_path)).where("content = ''").first()
    assert many.hash == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_code_of_pdf_pages_is_fenced_from_where_it_is_code(spark):
    prose = "  an indented line of prose\n  and another one\n  and a third\n"
    code = "    x = f(1)\n\n    y = x + 2\n    return (y)\n"
    rows = [(prose + code + "end", 1, ""), ("a\n    b = 1\n    c = 2\nd", 1, ""), ("", 0, None), (None, None, None)]
    got = [r.text for r in E.postprocess_pdf_text(spark.createDataFrame(rows, "text string, page_count int, alt_text string")).collect()]
    assert got[0].count("```") == 2 and got[0].index("```") > got[0].index("prose") and got[0].endswith("```\nend")
    assert "```" not in got[1] and got[2:] == ["", ""]
