"""Compilation, maintenance and ideas on rows with nulls, blanks, repeats and hot keys."""

from lorewell.operators import compiling as K
from lorewell.operators import ideas as I
from lorewell.operators import maintenance as M

CONCEPT = (
    "slug string, title string, status string, aliases array<string>, sources array<string>, definition string, "
    "synthesis string, compile_version int, last_compiled string"
)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_answers_that_cannot_be_read_give_an_error_and_empty_lists(spark):
    good = '```json\n{"existing_concepts": ["a", " ", null], "proposed_new_concepts": [{"slug": " n "}, {"slug": ""}]}\n```'
    raw = spark.createDataFrame([("k1", good), ("k2", "{oops"), ("k3", None), ("k4", "{}")], "article_key string, raw string")
    got = by(K.parse_assignments(raw), "article_key")
    assert got["k1",].existing == ["a"] and got["k1",].error is None
    assert [(p.slug, p.title) for p in got["k1",].proposed] == [("n", "n")]
    for key, error in (("k2", "json_parse_error"), ("k3", "json_parse_error"), ("k4", None)):
        assert (got[key,].existing, got[key,].proposed, got[key,].error) == ([], [], error)


def test_first_proposal_wins_and_known_slugs_stay(spark):
    answers = [(f"k{i}", '{"proposed_new_concepts": [{"slug": "%s", "title": "t%d"}]}' % (s, i)) for i, s in enumerate("xyxx")]
    a = K.parse_assignments(spark.createDataFrame(answers, "article_key string, raw string"))
    known = spark.createDataFrame([("y",)], "slug string")
    assert [(r.slug, r.title, r.sources) for r in K.proposed_concepts(a, known).collect()] == [("x", "t0", ["k0"])]


def test_sources_of_a_hot_concept_stay_whole_and_the_prompt_is_short(spark):
    concepts = spark.createDataFrame([("hot", "Hot", "stable", [], ["old"], "", "", 1, None)], CONCEPT)
    fed = spark.createDataFrame([("hot", f"k{i:03d}") for i in range(300)], "slug string, article_key string")
    got = K.concept_sources(concepts, fed, fed.where("article_key = 'k000'"))
    assert got.count() == 301
    assert [r.article_key for r in K.prompt_sources(got).orderBy("place").collect()] == [f"k{i:03d}" for i in range(8)]
    assert K.concept_sources(concepts, fed, fed.limit(0)).count() == 0


def test_merge_keeps_concepts_without_a_good_result(spark):
    rows = [(s, s, "proposed", ["A ", "a"], ["k"], "old", "s", 0, "bad date") for s in ("done", "failed", "none")]
    concepts = spark.createDataFrame(rows, CONCEPT)
    results = spark.createDataFrame(
        [("done", "new", " ", None), ("failed", None, None, "timeout")],
        "slug string, synthesis string, definition string, error string",
    )
    got = by(K.recompile_merge(concepts, results), "slug")
    assert (got["done",].status, got["done",].compile_version, got["done",].synthesis, got["done",].definition) == ("stable", 1, "new", "old")
    for s in ("failed", "none"):
        assert (got[s,].status, got[s,].compile_version, got[s,].synthesis) == ("proposed", 0, "s")
    state = spark.createDataFrame([("done", 2)], "slug string, conflicts int")
    kept = by(K.concept_state(concepts, state, "2026-01-01"), "slug")
    assert kept["done",].retrieval_hints == ["A", "done"] and kept["done",].conflicts == 2
    assert kept["none",].freshness == 0.0 and kept["none",].conflicts == 0 and kept["none",].importance == 0.2


def test_citations_follow_sources_to_concepts(spark):
    paths = ["kb/wiki/concepts/c1.md", "raw/a1/article.md", "raw/a1/article.md", "raw/a2/article.md", "elsewhere", None]
    got = spark.createDataFrame([(1, p) for p in paths], "query_id long, path string")
    concepts = spark.createDataFrame([("c1",), ("a2",)], "slug string")
    summaries = spark.createDataFrame([("a1", ["c1", "c2"])], "name string, feeds_concepts array<string>")
    rows = M.resolve_citations(got, concepts, summaries).collect()
    assert sorted((r.kind, r.name) for r in rows) == [("concept", "a2"), ("concept", "c1"), ("concept", "c2"), ("source", "a1")]


def test_clusters_and_suggestions(spark):
    rows = [(f"n{i:02d}", "risk_control", []) for i in range(20)] + [("one", None, []), ("fed", "risk_control", ["c"])]
    got = M.unmapped_clusters(spark.createDataFrame(rows, "name string, content_type string, feeds_concepts array<string>"))
    assert [tuple(r) for r in got.collect()] == [("risk-control-cluster", 20, [f"n{i:02d}" for i in range(8)])]
    state = spark.createDataFrame(
        [("a", "stable", 2, 0.4), ("b", "stable", 3, 0.5), ("c", "proposed", 0, 0.0)],
        "slug string, status string, source_count int, freshness double",
    )
    assert sorted((r.slug, r.kind) for r in M.suggestions(state).collect()) == [("a", "stale")] * 2 + [("a", "under_supported")] * 3


def test_scores_of_ideas(spark):
    ideas = spark.createDataFrame(
        [(1, 1, "from Alpha", "Alpha and Beta"), (2, 1, None, None), (3, 2, "x", "y")],
        "idea_id long, query_id long, inspired_by string, core_logic string",
    )
    titles = spark.createDataFrame([(1, "Alpha"), (1, "Alpha"), (1, "Beta"), (1, " "), (1, None)], "query_id long, title string")
    t = I.traceability(ideas, titles)
    assert {r.idea_id: r.traceability for r in t.collect()} == {1: 1.0, 2: 0.0, 3: 0.4}
    judged = spark.createDataFrame([(1, 2.0, -1.0), (2, None, None)], "idea_id long, coherence double, actionability double")
    assert {r.idea_id: r.quality for r in I.composite(t, judged).collect()} == {1: 0.65, 2: 0.35, 3: 0.47}
    matches = spark.createDataFrame([(1, 7, 0.9), (1, 6, 0.9), (2, 5, 0.7)], "idea_id long, id long, score double")
    assert {r.idea_id: (r.novel, r.best_id) for r in I.novelty(ideas, matches).collect()} == {1: (False, 6), 2: (True, None), 3: (True, None)}


def test_a_concept_that_all_articles_feed_compiles_with_bounded_rows(spark, monkeypatch):
    """With an edge table: the same concepts as with lists, and no row of more than a chunk."""
    from pyspark.sql import functions as F

    from lorewell.operators import edges as D
    from lorewell.operators import retrieval as R
    from lorewell.sources import scratch

    monkeypatch.setattr(D, "CHUNK", 50)
    n = 730
    notes = spark.range(n).select(
        F.format_string("raw/%04d", "id").alias("article_key"), F.col("id").cast("string").alias("hash"), F.lit("t").alias("title"),
        F.lit("reviewed").alias("status"), F.lit("").alias("summary"), F.lit("x").alias("content_type"), F.lit("m").alias("main_content"),
        F.array().cast("array<string>").alias("idea_blocks"),
    )
    schema = "slug string, title string, status string, aliases array<string>, sources array<string>, source_basenames array<string>, " \
        "compile_version int, synthesis string, definition string, last_compiled string, key_idea_blocks array<string>, " \
        "variants array<string>, failure_modes array<string>, transfer_targets array<string>, content_types array<string>"  # fmt: skip
    row = lambda slug, sources: (slug, slug, "stable", [], sources, sources, 0, "", "", "", [], [], [], [], [])
    concepts = spark.createDataFrame([row("hot", ["raw/9999"]), row("cold", ["raw/0001"]), row("still", ["raw/0002", "raw/0003"])], schema)
    answer = F.when(F.col("article_key") == "raw/0005", '{"existing_concepts": ["hot", "cold"], "proposed_new_concepts": [{"slug": "new"}]}')
    answer = answer.otherwise('{"existing_concepts": ["hot"]}').alias("raw")

    def compiled(edges=None):
        none = lambda s: spark.createDataFrame([], s)
        return K.compile_job(
            notes, concepts, none("article_key string"), none("path string, content_hash string, feeds_concepts array<string>"),
            none("slug string, conflicts int"), concepts.limit(0), lambda c: c.select("article_key", answer),
            lambda p: p.select("slug").distinct().select("slug", F.lit("s").alias("synthesis"), F.lit("").alias("definition"), F.lit(None).cast("string").alias("error")),
            scratch.kept, "2026-01-01", edges=edges,
        )

    lists = {r.slug: r for r in compiled().concepts.collect()}
    out = compiled(D.from_lists(concepts, scratch.kept))
    rows = out.edges.collect()
    assert max(len(r.articles) for r in rows) == 50 and len({(r.slug, r.chunk) for r in rows}) == len(rows)
    listed = {}
    for r in sorted(rows, key=lambda r: (r.slug, r.chunk)):
        listed.setdefault(r.slug, []).extend(r.articles)
    assert listed == {s: r.sources for s, r in lists.items()} and len(listed["hot"]) == n + 1
    got = {r.slug: r for r in out.concepts.collect()}
    assert {s: (r.status, r.compile_version, r.source_count) for s, r in got.items()} == {s: (r.status, r.compile_version, len(r.sources)) for s, r in lists.items()}
    assert {r.slug: r.source_count for r in out.concept_state.collect()} == {s: len(r.sources) for s, r in lists.items()}
    assert D.first_sources(D.placed(D.rows_of(out.edges), scratch.kept), 7).where("slug = 'hot'").first().sources == listed["hot"][:7]
    hits = spark.createDataFrame([(1, "hot")], "query_id long, slug string")
    found = spark.createDataFrame([(1, "raw/0100"), (1, "elsewhere"), (2, "raw/0100")], "query_id long, article_key string")
    kept = R.exclude_cited(found, hits, D.rows_of(out.edges)).collect()
    assert sorted(map(tuple, kept)) == [(1, "elsewhere"), (2, "raw/0100")]
