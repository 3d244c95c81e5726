"""Notes from files, long pages, ideas, retrieval by modes, jobs and the feedback stream on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import blocks as B
from lorewell.operators import concepts as C
from lorewell.operators import extraction as E
from lorewell.operators import indexing as X
from lorewell.operators import ingest as G
from lorewell.operators import linting as L
from lorewell.operators import maintenance as M
from lorewell.operators import notes as N
from lorewell.operators import outputs as O
from lorewell.operators import retrieval as R
from lorewell.operators import wiki_pages as W
from lorewell.sources import scratch


def test_notes_of_awkward_headers(spark):
    rows = [
        ("raw/a", '---\ntitle: "A: b"\nstatus: "high-value"\nmarket: ["x", 1]\nidea_blocks: ["i", "j"]\nidea_blocks: [no json]\n---\nbody'),
        ("raw/b", "---\ntitle:  \nstatus: raw\n---\n"),
        ("raw/c", "no header\n---\n"),
        ("raw/d", None),
        ("raw/e", "---\ntitle: 5\n## Main Content\n\nx"),
    ]
    got = {r.article_key: r for r in N.to_notes(spark.createDataFrame(rows, "article_key string, content string")).collect()}
    a = got["raw/a"]
    assert (a.title, a.status, a.market, a.idea_blocks, a.body) == ("A: b", "high-value", ["x", "1"], None, "body")
    assert (got["raw/b"].title, got["raw/b"].status) == ("raw/b", "raw")
    assert got["raw/c"].body == "no header\n---\n" and got["raw/d"].title == "raw/d"
    assert got["raw/e"].main_content == "x" and got["raw/e"].title == "raw/e"


def test_pages_with_very_long_lists_parse(spark):
    many = [f"raw/{i}" for i in range(20_000)]
    c = spark.createDataFrame([("t", "s", "stable", many, ["idea [a]"] * 20_000)], "title string, slug string, status string, sources array<string>, key_idea_blocks array<string>")
    row = W.parse_concept_pages(W.render_concept_pages(c)).first()
    assert row.sources == many and len(row.key_idea_blocks) == 20_000 and row.error is None
    s = spark.createDataFrame([("n", ["i1", "i2", "i3", "i4"], ["c"] * 20_000)], "name string, top_idea_blocks array<string>, feeds_concepts array<string>")
    row = W.parse_source_pages(W.render_source_pages(s)).first()
    assert row.top_idea_blocks == ["i1", "i2", "i3"] and len(row.feeds_concepts) == 20_000


ENGLISH = """Some words before.
## Idea Title
First one

**Inspired By**
a note
and another

Core Combination Logic
join them

**What Is New**
this
---
not a field
### Idea Title

Second one
**Possible Variants**
v1
What Could Break of it all
lost
"""
CHINESE = """开头
## 💡 创新策略一：甲
**核心逻辑：**
并
多余
**灵感来源**：某文
### 想法 2: 乙
**风险：** 无
"""


def test_ideas_line_by_line():
    first, second = O.ideas_of(ENGLISH)
    assert (first["title"], first["inspired_by"], first["core_logic"], first["what_is_new"]) == ("First one", "a note\nand another", "join them", "this")
    assert (second["title"], second["possible_variants"], second["what_could_break"]) == ("Second one", "v1", "")
    assert first["raw"].startswith("## Idea Title") and second["raw"].endswith("lost")
    one, two = O.ideas_of(CHINESE)
    assert (one["title"], one["core_logic"], one["inspired_by"]) == ("甲", "并", "某文") and (two["title"], two["what_could_break"]) == ("乙", "无")
    assert O.ideas_of("plain text\n## A heading: x") == O.ideas_of(None) == O.ideas_of("### Idea Title\n") == []


def test_formulas_of_each_mark(spark):
    rows = [
        ('x <annotation encoding="application/x-tex"> a^2 </annotation> y', "x $a^2$ y", True),
        ("<script type='math/tex; mode=display'>b</script>", "$b$", True),
        ("\\( c \\) and \\[ d \\] and \\( open", "$c$ and $$d$$ and \\( open", True),
        ("<annotation>no</annotation> <script>x=1</script>", "<annotation>no</annotation> <script>x=1</script>", False),
        ("costs $5", "costs $5", False),
        ("$\n$ and $$x$$", "$\n$ and $$x$$", True),
        ("$$a\nb$$", "$$a\nb$$", True),
        ("$\na$", "$\na$", False),
    ]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string").coalesce(1)
    got = df.select(E.math_to_markdown(F.col("t")).alias("m"), E.has_math(F.col("t")).alias("h")).collect()
    assert [(r.m, r.h) for r in got] == [(m, h) for _, m, h in rows]
    html = "<pre class='language-py x'>a &lt; b &amp;&lt;</pre><PRE><code class=\"language-c++\">\n y </code></PRE><pre> </pre>"
    blocks = spark.createDataFrame([(html,)], "h string").select(E.class_code_blocks(F.col("h")).alias("b")).first().b
    assert [(b.language, b.content) for b in blocks] == [("py", "a < b &<"), ("c++", "\n y")]


def test_keyword_lists_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    types = ["idea_blocks", "summary", "main_content", "failure_modes"]
    blocks = [(f"raw/{i % 17}", i // 17, rng.choice(types), " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(400)]
    blocks += [("raw/x", 0, "summary", None), ("raw/y", 0, "summary", "")]
    queries = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 8, 16])))) for i in range(30)] + [(99, None), (98, "unknown")]
    b = spark.createDataFrame(blocks, "article_key string, ordinal int, block_type string, text string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, text string")
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "QUERY_TILE", 2)
    for limit, per in ((16, 3), (5, 1), (8, None)):
        got = [tuple(r) for r in R.keyword_top(b, q, limit, per).select("query_id", "rank", "article_key", "ordinal", "score").collect()]
        want = []
        for i, text in queries:
            asked, scored = set((text or "").split()), []
            for key, ordinal, kind, t in blocks:
                n = len(asked & set((t or "").split()))
                if n:
                    score = round(n / len(asked) + R.TYPE_BONUS.get(kind, 0), 6)
                    scored.append((-round(score + R.RANK_BONUS.get(kind, 0), 6), key, ordinal, score))
            taken, of_article = [], {}
            for x in sorted(scored):
                of_article[x[1]] = of_article.get(x[1], 0) + 1
                if not per or of_article[x[1]] <= per:
                    taken.append(x)
            want += [(i, k + 1, key, ordinal, score) for k, (_, key, ordinal, score) in enumerate(taken[:limit])]
        assert sorted(got) == sorted(want)


def test_vectors_of_other_kinds_match_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0])]
    index = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(1).where("id > 0")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    got = R.vector_scores(index, q, 5).collect()
    assert [(r.query_id, r.id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(9, 1, 1.0), (9, 5, 0.707107), (9, 4, 0.0)]
    assert R.vector_scores(index, q.where("query_id < 0"), 5).count() == 0


@pytest.fixture
def lists(spark):
    cols = "query_id long, article_key string, ordinal int, block_type string, rank int"
    keyword = spark.createDataFrame([(1, "a", 0, "t", 1), (1, "b", 0, "t", 2), (1, "c", 0, "t", 3), (2, "a", 0, "t", 1)], cols)
    vector = spark.createDataFrame([(1, "b", 0, "t", 1), (1, "a", 0, "t", 2), (2, "a", 0, "t", 1)], cols)
    hits = spark.createDataFrame([(1, "s", 1.0, 1), (2, "s", 1.0, 1)], "query_id long, slug string, score double, rank int")
    concepts = spark.createDataFrame([("s", ["a"])], "slug string, sources array<string>")
    return spark.createDataFrame([(1,), (2,)], "query_id long"), keyword, vector, hits, concepts


@pytest.mark.parametrize(
    "mode,use_hits,use_vector,strict,want",
    [
        ("keyword", True, True, False, {1: ["s", "b", "c"], 2: ["s"]}),
        ("keyword", False, False, False, {1: ["a", "b", "c"], 2: ["a"]}),
        ("vector", True, True, False, {1: ["s", "b"], 2: ["s", "a"]}),  # query 2 falls back to its whole keyword list
        ("vector", True, True, True, {1: ["s", "b"], 2: ["s"]}),
        ("hybrid", True, True, False, {1: ["s", "b", "a"], 2: ["s", "a"]}),  # cut to three places; only vectors leave sources out
        ("hybrid", True, False, False, {1: ["s", "b", "c"], 2: ["s"]}),  # no vector index: keyword list without sources
    ],
)
def test_retrieval_modes(lists, mode, use_hits, use_vector, strict, want):
    queries, keyword, vector, hits, concepts = lists
    got = R.retrieve(queries, keyword, vector if use_vector else None, hits if use_hits else None, concepts, mode, 3, strict).collect()
    names = {i: [r.name for r in sorted(got, key=lambda r: r.place) if r.query_id == i] for i in (1, 2)}
    assert names == want
    resolved = {r.query_id: (r.mode, r.warning is None) for r in got}
    assert resolved[1] == (mode if use_vector else "keyword", use_vector or mode == "keyword")
    assert resolved[2] == ("keyword", mode == "keyword")


def test_vector_blocks_after_the_fetch(spark):
    near = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(6)], "query_id long, id long, score double")
    index = spark.createDataFrame([(i, ["a", "b", "wiki/x"][i % 3], i, "summary") for i in range(6)], "id long, article_key string, ordinal int, block_type string")
    allowed = spark.createDataFrame([("a",), ("b",), ("b",)], "article_key string")
    got = sorted((r["rank"], r.article_key, r.ordinal) for r in R.vector_top(near, index, allowed, 3, 1).collect())
    assert got == [(1, "a", 0), (2, "b", 1)]


def test_index_job_keeps_what_failed(spark):
    notes = spark.createDataFrame(
        [("raw/a", "reviewed", "ca", "good"), ("raw/b", "reviewed", "cb", "bad"), ("raw/c", "reviewed", "cc", "same")],
        "article_key string, status string, content string, summary string",
    ).withColumn("main_content", F.lit(""))
    same = notes.where("article_key = 'raw/c'").select("article_key", B.index_hash(F.col("content")).alias("hash"), F.lit(1).alias("block_count"), F.lit("reviewed").alias("source_dir"))
    index = spark.createDataFrame([(f"raw/{x}", f"old-{x}", "article") for x in "abcz"], "article_key string, block_id string, kb_layer string")
    concepts = spark.createDataFrame([("s", "t", "stable", ["raw/a"], "syn")], "slug string, title string, status string, sources array<string>, synthesis string")
    none = spark.createDataFrame([], "slug string, confidence double, importance double, freshness double, source_count int")
    summaries = spark.createDataFrame([], "article_key string, content_type string, takeaway string, top_idea_blocks array<string>")

    def embed(texts):
        if "bad" in texts:
            raise ValueError("no vector")
        return [[1.0] for _ in texts]

    out = X.index_job(notes, concepts, summaries, none, index, same, embed, scratch.kept)
    assert sorted(r.block_id[:7] for r in out.index.collect()) == ["old-b", "old-c", "old-z", "raw__a_", "wiki__c"]
    assert sorted(r.article_key for r in out.manifest.collect()) == ["raw/a", "raw/c"]
    assert [(r.key, r.error_class) for r in out.failures.collect()] == [("raw/b", "embedding_error")]
    assert tuple(out.summary.first()) == (3, 1, 1, 1)
    pruned = B.upsert_blocks(index, index.limit(0), notes.limit(0), notes.select("article_key"))
    assert sorted(r.block_id for r in pruned.collect()) == ["old-a", "old-b", "old-c"]


def test_last_status_counts_and_summaries_decide(spark):
    notes = spark.createDataFrame([("a", "u", "t", "raw", "")], "article_key string, url string, title string, status string, brainstorm_value string")
    ups = spark.createDataFrame([(1, "a", "reviewed", ""), (2, "a", "high_value", ""), (3, "a", "nonsense", "")], "place int, article_key string, status string, reason string")
    none = spark.createDataFrame([], "place long, source_url string, title string, reason string")
    assert G.set_article_status(notes, ups, none)[0].first().status == "high_value"
    now = spark.createDataFrame([("a", "h"), ("b", "h")], "article_key string, hash string")
    got = B.changed_articles(now, now, summaries=now.where("article_key = 'a'"))
    assert {r.article_key: r.state for r in got.collect()} == {"a": "same", "b": "changed"}


def test_lint_follow_ups(spark):
    issues = spark.createDataFrame([("warning", "k", f"p{i:02d}", "m") for i in range(15)] + [("error", "k", "p", "m")], "severity string, kind string, path string, message string")
    assert sorted((r.severity, r.place) for r in L.issue_sample(issues).collect()) == [("error", 1)] + [("warning", i) for i in range(1, 11)]
    concepts = spark.createDataFrame([("a", "stable", 2, "s", "d"), ("b", "stable", 0, "s", "d")], "slug string, status string, compile_version int, synthesis string, definition string")
    results = spark.createDataFrame([("a", "new", "nd", None), ("b", "x", "y", "failed")], "slug string, synthesis string, definition string, error string")
    assert sorted(tuple(r) for r in L.repaired(concepts, results).collect()) == [("a", "stable", 3, "new", "nd"), ("b", "stable", 0, "s", "d")]


def test_answers_without_ideas_pass_through(spark):
    outputs = spark.createDataFrame([(1, "### Idea Title\nT\n\n**Inspired By**\nAlpha  \n"), (2, "no ideas"), (3, None)], "output_id long, text string")
    titles = spark.createDataFrame([(1, "Alpha")], "query_id long, title string")
    near = spark.createDataFrame([("1#0", 5, 0.9)], "idea_id string, id long, score double")
    judged = spark.createDataFrame([], "idea_id string, coherence double, actionability double")
    got = {r.output_id: r.text for r in O.rethink_reports(outputs, O.rethink(outputs, titles, near, judged)).collect()}
    assert got[2] == "no ideas" and got[3] is None
    assert got[1].endswith("### Idea 1: T\n- **Quality Score**: 0.59 (Traceability: 0.8)\n- **Novelty**: Similar to existing — 5") and "## Rethink Report" in got[1]


def test_latest_output_and_hints(spark):
    rows = [(1, "ask", 5, "b"), (1, "ask", 5, "a"), (1, "brainstorm", 1, "c"), (1, "ask", 4, "z")]
    got = M.latest_output(spark.createDataFrame(rows, "query_id long, mode string, written_at long, path string")).collect()
    assert sorted((r.mode, r.path) for r in got) == [("ask", "b"), ("brainstorm", "c")]
    state = spark.createDataFrame([("a", ["x"]), ("b", None)], "slug string, retrieval_hints array<string>")
    hints = spark.createDataFrame([("a", i, f"h{i}") for i in range(20)] + [("a", 30, "x"), ("b", 1, "y"), ("gone", 1, "z")], "slug string, place long, hint string")
    got = {r.slug: r.retrieval_hints for r in C.with_hints(state, hints).collect()}
    assert got == {"a": [f"h{i}" for i in range(8, 20)], "b": ["y"]}


def test_recompiled_lists_and_sources_are_taken_over(spark):
    from lorewell.operators import compiling as K

    cols = "slug string, status string, compile_version int, synthesis string, definition string, sources array<string>, variants array<string>, last_compiled string"
    concepts = spark.createDataFrame([("a", "proposed", 0, "s", "d", ["x"], ["v"], ""), ("b", "stable", 1, "s", "d", ["x"], ["v"], "")], cols)
    results = spark.createDataFrame([("a", "n", " ", ["w"], None), ("b", "n", "n", ["w"], "failed")], "slug string, synthesis string, definition string, variants array<string>, error string")
    sets = K.source_sets(spark.createDataFrame([("a", "raw/y"), ("a", "raw/x"), ("b", "raw/z")], "slug string, article_key string"))
    got = {r.slug: tuple(r[c] for c in concepts.columns[1:]) for r in K.recompile_merge(concepts, results, sets, "2026-01-01").collect()}
    assert got == {"a": ("stable", 1, "n", "d", ["raw/x", "raw/y"], ["w"], "2026-01-01"), "b": ("stable", 1, "s", "d", ["x"], ["v"], "")}


def test_concepts_by_words_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(15)]
    concepts = [(f"c{i}", " ".join(rng.choices(words, k=3)), "stable" if i % 5 else "proposed", [rng.choice(words)], "Def " + rng.choice(words)) for i in range(90)]
    state = [(f"c{i}", rng.choice([0.0, 0.5, 1.0]), 0.5, 0.1, i % 4, i % 2, [rng.choice(words)]) for i in range(60)]
    queries = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4])))) for i in range(20)] + [(50, None)]
    c = spark.createDataFrame(concepts, "slug string, title string, status string, aliases array<string>, definition string").repartition(4)
    st = "slug string, confidence double, importance double, freshness double, source_count int, conflicts int, retrieval_hints array<string>"
    s = spark.createDataFrame(state, st)
    q = spark.createDataFrame(queries, "query_id long, text string")
    monkeypatch.setattr(R, "QUERY_TILE", 3)
    memory = {r.slug: (r.memory, r.hints) for r in R._memory(s).collect()}
    got = {}
    for r in R.concepts_by_words(c, q, s).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.slug, r.score)
    for i, text in queries:
        asked, scored = set((text or "").split()), []
        for slug, title, status, aliases, definition in concepts:
            m, hints = memory.get(slug, (0.0, [*aliases, title]))
            n = len(asked & {w for t in (title, *hints, definition.lower()) for w in t.split()})
            if status == "stable" and n:
                scored.append((-round(n + 2 * m, 6), slug))
        assert [got.get(i, {}).get(k + 1) for k in range(3)] == [*[(s_, -x) for x, s_ in sorted(scored)[:3]], None, None, None][:3]


def test_a_second_compilation_asks_no_model(spark):
    from lorewell.operators import compiling as K

    none = lambda schema: spark.createDataFrame([], schema)
    notes = spark.createDataFrame([("raw/a", "h1", ["i"]), ("raw/b", "h2", None)], "article_key string, hash string, idea_blocks array<string>")
    concepts = "slug string, title string, status string, aliases array<string>, sources array<string>, definition string, synthesis string, compile_version int, last_compiled string, key_idea_blocks array<string>"
    seeds = spark.createDataFrame([("s", "S", "stable", ["al"], [], "d", "", 0, "", [])], concepts)
    asked = []

    def assign(changed):
        rows = [r.article_key for r in changed.collect()]
        asked.append(sorted(rows))
        answers = {"raw/a": '{"existing_concepts": ["s"]}', "raw/b": '{"proposed_new_concepts": [{"slug": "p"}]}'}
        return spark.createDataFrame([(k, answers[k]) for k in rows], "article_key string, raw string")

    def recompile(prompts):
        rows = sorted((r.slug, r.article_key) for r in prompts.collect())
        asked.append(rows)
        return spark.createDataFrame([(x, "syn", "", None) for x, _ in rows], "slug string, synthesis string, definition string, error string")

    def run(c, summaries, sources, state, mode="incremental"):
        return K.compile_job(notes, c, summaries, sources, state, seeds, assign, recompile, scratch.kept, "2026-01-01", mode)

    empty = none(concepts), none("article_key string"), none("path string, content_hash string, feeds_concepts array<string>"), none("slug string, conflicts int")
    first = run(*empty)
    assert asked == [["raw/a", "raw/b"], [("s", "raw/a")]]
    assert sorted((r.slug, r.status, r.compile_version, r.sources) for r in first.concepts.collect()) == [("p", "proposed", 0, ["raw/b"]), ("s", "stable", 1, ["raw/a"])]
    assert {r.path: r.feeds_concepts for r in first.source_state.collect()} == {"raw/a": ["s"], "raw/b": ["p"]}
    asked.clear()
    again = run(first.concepts, first.summaries, first.source_state, first.concept_state)
    assert asked == [[], []] and again.report.first().skipped == 2
    assert sorted(map(tuple, again.concepts.collect())) == sorted(map(tuple, first.concepts.select(*again.concepts.columns).collect()))
    asked.clear()
    rebuilt = run(first.concepts, first.summaries, first.source_state, first.concept_state, "rebuild")
    assert asked[0] == ["raw/a", "raw/b"] and rebuilt.report.first().skipped == 0
