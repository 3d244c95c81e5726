"""Pages read back as written, lint over pages, model plugs and the page stream."""

from lorewell.operators import models
from lorewell.operators import wiki_pages as W
from lorewell.streaming.ingest import stream_ingest

LISTS = ["aliases", "related_concepts", "sources", "content_types", *W.LIST_SECTIONS]
SCHEMA = "title string, slug string, status string, last_compiled string, compile_version int, synthesis string, definition string, "
SCHEMA += ", ".join(f"{n} array<string>" for n in LISTS)


def test_concepts_read_back(spark):
    full = ("A: title", "a-b", "stable", "2026-01-01", 3, "two\n\nparts", "d", *[[f"{n} one", "two"] for n in LISTS])
    bare = ("", "x", "proposed", "", 0, "", "", *[[] for _ in LISTS])
    df = spark.createDataFrame([full, bare], SCHEMA)
    got = {r.slug: r for r in W.parse_concept_pages(W.render_concept_pages(df)).collect()}
    for row, names in ((full, SCHEMA.split(", ")), (bare, SCHEMA.split(", "))):
        r = got[row[1]]
        assert r.error is None and r.page_path == f"wiki/concepts/{row[1]}.md"
        for value, name in zip(row, (n.split(" ")[0] for n in names), strict=True):
            want = "_pending_" if name in W.TEXT_SECTIONS and value == "" else value
            assert r[name] == want, name
    nulls = spark.createDataFrame([(None, "n", *[None] * (5 + len(LISTS)))], SCHEMA)
    (r,) = W.parse_concept_pages(W.render_concept_pages(nulls)).collect()
    assert (r.title, r.status, r.compile_version, r.aliases, r.error) == ("", "proposed", 0, [], None)


def test_sources_read_back(spark):
    schema = "name string, source_path string, title string, content_type string, brainstorm_value string, feeds_concepts array<string>, "
    schema += "ingested string, last_compiled string, takeaway string, top_idea_blocks array<string>, why_in_kb string"
    rows = [("n1", "raw/n1", "T", "strategy", "high", ["a", "b"], "2026-01-01", "", "t", list("wxyz"), "why"), ("n2", None, None, None, "odd", None, None, None, None, None, None)]
    got = {r.page_path: r for r in W.parse_source_pages(W.render_source_pages(spark.createDataFrame(rows, schema))).collect()}
    a, b = got["wiki/sources/n1.md"], got["wiki/sources/n2.md"]
    assert (a.title, a.feeds_concepts, a.takeaway, a.top_idea_blocks, a.why_in_kb, a.error) == ("T", ["a", "b"], "t", list("wxy"), "why", None)
    assert (b.title, b.feeds_concepts, b.takeaway, b.top_idea_blocks) == ("", [], "", [])
    pages = W.render_source_pages(spark.createDataFrame(rows, schema)).unionByName(spark.createDataFrame([("p", "loose"), ("q", None)], "page_path string, content string"))
    kinds = sorted((r.page_path, r.kind) for r in W.lint_source_pages(W.parse_source_pages(pages)).collect())
    assert kinds == [("p", "malformed_source_summary"), ("q", "malformed_source_summary"), ("wiki/sources/n2.md", "schema_invalid_enum")]


def test_lint_of_concept_pages(spark):
    head = "---\ntitle: t\nslug: {}\nstatus: {}\ncompile_version: {}\n---\n\n"
    rows = [("bad", head.format("No Slug", "stable", 1)), ("odd", head.format("a", "odd", 1)), ("old", head.format("a", "deprecated", 1)),
            ("big", head.format("a", "stable", "x")), ("few", head.format("b", "stable", 1) + "## Synthesis\n\nyes\n\n## Definition\n\n_pending_\n" + "z" * 9000), ("nul", None)]
    got = W.lint_concept_pages(W.parse_concept_pages(spark.createDataFrame(rows, "page_path string, content string"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_path, []).append(r.kind)
    assert by["bad"] == by["odd"] == by["big"] == by["nul"] == ["malformed_concept"] and "old" not in by
    assert sorted(by["few"]) == ["oversized_concepts", "schema_empty_definition", *["schema_missing_section"] * 7]


def test_models(spark):
    def chat(prompt):
        if prompt == "fail":
            raise ValueError("no")
        return prompt.upper()

    rows = spark.createDataFrame([("a", "x"), ("b", "fail"), ("c", None)], "article_key string, prompt string")
    got = sorted(tuple(r) for r in models.call_model(rows, chat, 2).collect())
    assert got == [("a", "X", None), ("b", None, "ValueError: no"), ("c", "", None)]

    def embed(texts):
        if "fail" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    blocks = spark.createDataFrame([("1", "abc"), ("2", "fail"), ("3", None)], "block_id string, text string")
    got = {r.block_id: (r.embedding, r.embed_error) for r in models.with_embeddings(blocks, embed).collect()}
    assert got == {"1": ([3.0], None), "2": (None, "ValueError: no"), "3": ([0.0], None)}


def test_stream_writes_each_article_once(spark, tmp_path):
    rejected = spark.createDataFrame([], "place long, source_url string, title string, reason string")
    page = lambda *ids: spark.createDataFrame([(f"u{i}", f"<title>T{i}</title>") for i in ids], "url string, html string")
    run = lambda: stream_ingest(
        spark.readStream.schema("url string, html string").parquet(f"{tmp_path}/in"), rejected, f"{tmp_path}/out", f"{tmp_path}/check", "2026-01-01"
    ).awaitTermination()
    page(1, 2).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    page(2, 3).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["T1", "T2", "T3"]
