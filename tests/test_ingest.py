"""Pages, answers, files and the gate on small inputs with nulls, blanks and repeats."""

import json

from pyspark.sql import functions as F

from lorewell.functions import markup
from lorewell.operators import enrichment as N
from lorewell.operators import extraction as E
from lorewell.operators import ingest as G
from lorewell.operators import outputs as O
from lorewell.operators import seeds as S
from lorewell.sources import files

PAGE = """<html><head><title>plain</title><meta content="Risk &amp; parity: a/b" property="og:title">
<meta name="author" content="Ann"></head><body><nav>menu</nav><article><h1>Head</h1><p>First <b>bold</b> line
<script>var x;</script><pre><code class="language-python">def f(x):
    return x + 1  # twice</code></pre><p>use <code>f(x) = 1</code> and <code>abc</code>
<img src="/a.png"><img data-src="//c/d.png" src="z"><img src="/a.png"></article>
<em id="publish_time">on 2024/3/5</em>\\(a+b\\)</body></html>"""


def one(df):
    (row,) = df.collect()
    return row


def test_page(spark):
    got = one(E.extract_articles(spark.createDataFrame([("https://h/x/y", PAGE, 7)], "url string, html string, more int"), "2026-01-01"))
    assert (got.title, got.account, got.published) == ("Risk & parity_ a_b", "Ann", "2024-03-05")
    assert got.main_content == "Head\nFirst\nbold\nline\nuse\nand\nabc"
    assert [(b.language, b.content) for b in got.code_blocks] == [("python", "def f(x):\n    return x + 1  # twice")]
    assert got.image_urls == ["https://h/a.png", "https://c/d.png"]
    assert (got.has_code, got.has_math, got.blocked, got.paywalled, got.quality) == (True, True, False, False, "full")
    assert got.content_type == "risk_control" or got.content_type == "methodology"
    assert got.article_key.startswith("2024-03-05_risk_&_parity_a_b_") and got.more == 7
    assert "```python\ndef f(x):" in got.markdown


def test_blank_and_blocked_pages(spark):
    rows = [(None, None), ("u", ""), ("v", "<body>去验证</body>"), ("w", "<p>no container, please Subscribe</p>")]
    got = {r.url: r for r in E.extract_articles(spark.createDataFrame(rows, "url string, html string"), "2026-01-01").collect()}
    assert got[None].main_content == got["u"].main_content == got["w"].main_content == ""
    assert got["u"].title == "untitled" and got["u"].quality == "text_only"
    assert got["v"].blocked and got["v"].main_content == "去验证"


def test_fields_and_math(spark):
    t = spark.createDataFrame([("如何做", "short\nthis is a long line\nand another one"), (None, None)], "title string, main_content string")
    a, b = E.heuristic_fields(t).collect()
    assert (a.summary, a.core_hypothesis, a.research_question) == ("this is a long line\n\nand another one", "this is a long line", "如何做")
    assert (b.summary, b.research_question, b.content_type) == ("", "", "methodology")
    m = spark.createDataFrame([(r'\( a \) \[ b \] <annotation encoding="application/x-tex"> c </annotation>',)], "t string")
    assert one(m.select(E.math_to_markdown(F.col("t")).alias("t"))).t == "$a$ $$b$$ $c$"


def test_pdf_text(spark):
    code = "text\n\n  a = (1)\n  b = [2]\n\n  c = {3}\nend"
    rows = [(code, 1, None), ("x", 5, "longer ∑"), (None, None, None)]
    a, b, c = E.postprocess_pdf_text(spark.createDataFrame(rows, "text string, page_count int, alt_text string")).collect()
    assert a.text == "text\n```\n\n  a = (1)\n  b = [2]\n\n  c = {3}\n```\nend" and a.quality == "full"
    assert (b.text, b.quality, b.has_math) == ("longer ∑", "partial", True)
    assert (c.text, c.quality) == ("", "text_only")


def test_gate(spark):
    pages = [("u1", "<title>A</title>"), ("u1", "<title>A</title>"), ("u2", "<title>B</title>"), ("u3", "<title>C</title>"), ("u4", "去验证")]
    pages = spark.createDataFrame(pages, "url string, html string")
    bad = spark.createDataFrame([(2, "u2", "", "late"), (1, "", "B", "early"), (1, "", "", "blank")], "place long, source_url string, title string, reason string")
    none = spark.createDataFrame([], "article_key string")
    got = G.ingest_job(pages, none, bad, "2026-01-01")
    states = sorted((r.url, r.state, r.rejected_reason) for r in got.collect())
    assert [s[:2] for s in states] == [("u1", "skipped"), ("u1", "success"), ("u2", "rejected"), ("u3", "success"), ("u4", "failed")]
    assert states[2][2] == "early"
    kept = got.where("state = 'success'")
    assert {r.state for r in G.ingest_job(pages.where("url = 'u3'"), kept, bad, "2026-01-01").collect()} == {"skipped"}
    s = one(G.run_summary(got))
    assert (s.total, s.success, s.skipped, s.failed, s.rejected) == (5, 2, 1, 1, 1)
    assert one(G.failure_table(got, "url")).error_class == "blocked_wechat_page"


def test_urls(spark):
    lines = spark.createDataFrame([(1, "http://a；"), (2, "# no"), (3, None), (4, "http://b;"), (5, "http://a")], "place int, line string")
    assert [r.url for r in G.clean_urls(lines).orderBy("place").collect()] == ["http://a", "http://b"]
    pasted = spark.createDataFrame([(1, "x,y；x; z")], "place int, line string")
    assert sorted(r.url for r in G.clean_urls(pasted, pasted=True).collect()) == ["x", "y", "z"]


def test_status(spark):
    notes = spark.createDataFrame([("k1", "raw", "u1", "T1", "low"), ("k2", "raw", "u2", "T2", "")], "article_key string, status string, url string, title string, brainstorm_value string")
    ups = spark.createDataFrame([("k1", "rejected", ""), ("k2", "odd", "x"), ("k9", "reviewed", "")], "article_key string, status string, reason string")
    empty = spark.createDataFrame([], "place long, source_url string, title string, reason string")
    new, rejected, unknown = G.set_article_status(notes, ups, empty)
    assert {r.article_key: r.status for r in new.collect()} == {"k1": "rejected", "k2": "raw"}
    assert [(r.source_url, r.reason) for r in rejected.collect()] == [("u1", "low")]
    assert [r.article_key for r in unknown.collect()] == ["k9"]
    assert G.set_article_status(notes, ups, rejected)[1].count() == 1
    c = S.bootstrap(S.seed_concepts(spark, "2026-01-01").limit(1), S.seed_concepts(spark, "2026-01-01"))
    ups = spark.createDataFrame([("risk-parity", "deleted"), ("etf-rotation", "deprecated"), ("factor-models", "odd")], "slug string, status string")
    got = {r.slug: r.status for r in G.list_concepts(G.set_concept_status(c, ups)).collect()}
    assert len(got) == 6 and got["etf-rotation"] == "deprecated" and got["factor-models"] == "stable"


def test_enrichment(spark):
    data = {"summary": " s ", "idea_blocks": list("abcdef"), "market": ["fx", "odd"], "failure_modes": "one", "confidence": 2,
            "reusability": "bad", "entry_rule": "in", "rebalance_logic": "r", "backtest_metrics": {"x": 1}}
    rows = [("k1", "strategy", "```json\n" + json.dumps(data) + "\n```"), ("k2", "odd", json.dumps(data)), ("k3", "strategy", "{oops"), ("k4", None, None), ("k5", "strategy", "[1]")]
    got = N.parse_enrichment(spark.createDataFrame(rows, "article_key string, content_type string, raw string"))
    r = {x.article_key: x for x in got.collect()}
    assert (r["k1"].summary, r["k1"].idea_blocks, r["k1"].market, r["k1"].failure_modes) == ("s", list("abcde"), ["fx"], ["one"])
    assert (r["k1"].confidence, r["k1"].reusability, r["k1"].entry_rule, json.loads(r["k1"].backtest_metrics)) == (1.0, "", "in", {"x": 1})
    assert (r["k2"].content_type, r["k2"].entry_rule, r["k2"].rebalance_logic, r["k2"].backtest_metrics) == ("methodology", "", "", "{}")
    assert [r[k].error for k in ("k1", "k2", "k3", "k4", "k5")] == [None, None, *["json_parse_error"] * 3]
    body = "## Summary\n\nold\n\n## Idea Blocks\n\nx\n\n## Entry Rule\n\ny"
    notes = spark.createDataFrame([(k, "old", body) for k in ("k1", "k3", "k7")], "article_key string, summary string, body string")
    m = {x.article_key: x for x in N.merge_enrichment(notes, got, "m", "now").collect()}
    assert m["k1"].summary == "s" and m["k1"].body == "## Summary\n\ns\n\n## Idea Blocks\n\n- a\n- b\n- c\n- d\n- e\n\n## Entry Rule\n\nin\n"
    assert (m["k3"].summary, m["k3"].body, m["k3"].llm_enriched, m["k3"].llm_error) == ("old", body, False, "json_parse_error")
    assert (m["k7"].llm_enriched, m["k7"].llm_error) == (False, "")


def test_ideas(spark):
    en = "intro\n### Idea Title\nAlpha\n\n**Inspired By**\nsrc one\n\nWhat Is New\nnew\n---\n**Idea Title**\nBeta\nCore Combination Logic\nlogic"
    cn = "## 💡 策略一：标题\n**灵感来源**：甲\n**核心逻辑**：乙\n---"
    rows = spark.createDataFrame([(1, en), (2, cn), (3, None), (4, "nothing")], "output_id int, text string")
    got = {(r.output_id, r.title): r for r in O.parse_ideas(rows).collect()}
    assert sorted(got) == [(1, "Alpha"), (1, "Beta"), (2, "标题")]
    assert (got[1, "Alpha"].inspired_by, got[1, "Alpha"].what_is_new, got[1, "Beta"].core_logic) == ("src one", "new", "logic")
    assert (got[2, "标题"].inspired_by, got[2, "标题"].core_logic) == ("甲", "乙")


def test_files(spark, tmp_path):
    assert files.read_articles(spark, f"{tmp_path}/none").count() == 0
    for k, text in (("a1", "---\nx: 1\n---\nbody"), ("a2", "\n"), ("a3", "")):
        (tmp_path / "raw" / k).mkdir(parents=True)
        (tmp_path / "raw" / k / "article.md").write_text(text)
    (tmp_path / "raw/a1/source.json").write_text('{"source_url": "u", "llm_enriched": true}')
    got = files.with_sidecars(files.read_articles(spark, str(tmp_path)), files.read_sidecars(spark, str(tmp_path)))
    assert sorted((r.article_key, r.content, r.source_url) for r in got.collect()) == [("a1", "---\nx: 1\n---\nbody", "u"), ("a2", "\n", None), ("a3", "", None)]
    state = {"schema_version": "1", "sources": {"p": {"content_hash": "h", "feeds_concepts": ["a", ""]}, "bad": 3}, "concepts": {"c": {"importance": 0.5}}}
    texts = spark.createDataFrame([(json.dumps(state),), ("{",), (None,), ('{"schema_version": "0", "sources": {"q": {}}}',)], "value string")
    sources, concepts = files.state_from_json(texts)
    assert [(r.path, r.content_hash, r.feeds_concepts) for r in sources.collect()] == [("p", "h", ["a"])]
    c = one(concepts)
    assert (c.slug, c.status, c.importance, c.retrieval_hints) == ("c", "stable", 0.5, [])
    files.write_state(concepts, f"{tmp_path}/state")
    assert files.read_state(spark, f"{tmp_path}/state", files.CONCEPT_STATE).count() == 1
    assert files.read_state(spark, f"{tmp_path}/state", files.CONCEPT_STATE, version="2").count() == 0
    assert files.read_state(spark, f"{tmp_path}/no", files.CONCEPT_STATE).count() == 0


def test_reader_keeps_first_container():
    got = markup.read_page("<main>m<article>a</article></main><article>b</article><div id=js_content>j</div>", "")
    assert got["main_content"] == "j"
    assert markup.read_page("<main>m<article>a</article>n</main><article>b</article>", "")["main_content"] == "a"


def test_one_of_many_copies_comes_in(spark):
    pages = spark.range(0, 500, 1, 8).selectExpr("'u' AS url", "'<title>A</title>' AS html")
    bad = spark.createDataFrame([], "place long, source_url string, title string, reason string")
    s = one(G.run_summary(G.ingest_job(pages, spark.createDataFrame([], "article_key string"), bad, "2026-01-01")))
    assert (s.total, s.success, s.skipped) == (500, 1, 499)
