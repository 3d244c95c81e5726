"""The registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import blocks as B
from lorewell.operators import compiling as K
from lorewell.operators import concepts as C
from lorewell.operators import enrichment as A
from lorewell.operators import extraction as E
from lorewell.operators import ideas as I
from lorewell.operators import ingest as G
from lorewell.operators import maintenance as M
from lorewell.operators import notes as N
from lorewell.operators import outputs as O
from lorewell.operators import retrieval as R
from lorewell.operators import seeds as S
from lorewell.operators import wiki_pages as W
from lorewell.plans import views as V
from lorewell.sources import scratch


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.build_blocks(N.filter_notes(V.notes(spark, sf_dir)))


def _keyword_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_top(_blocks(spark, sf_dir), V.queries(spark, sf_dir), limit=16)


def _vector_top(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    return R.vector_scores(e.select(F.col("vec_id").alias("id"), "embedding"), V.asked_vectors(spark, sf_dir), n)


def token_counts(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


def slugs(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    return n.select("doc_id", T.slugify(F.col("title"), 60).alias("slug"))


def url_routes(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", T.route_url(F.col("url")).alias("route"))


def stages(spark, sf_dir):
    return N.stage_listing(V.notes(spark, sf_dir))


def facet_filter(spark, sf_dir):
    return N.filter_notes(V.notes(spark, sf_dir), market=["en", "de"]).select("article_key", "status", "title")


def sync_plan(spark, sf_dir):
    return N.sync_plan(V.notes(spark, sf_dir))


def blocks(spark, sf_dir):
    return B.with_block_id(_blocks(spark, sf_dir)).select("block_id", "article_key", "ordinal", "block_type", "text")


def block_counts(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    return B.block_counts(n, B.build_blocks(N.filter_notes(n)))


def changed(spark, sf_dir):
    return B.changed_articles(V.notes(spark, sf_dir).select("article_key", "hash"), V.manifest(spark, sf_dir)).select(
        "article_key", "state"
    )


def retrieve_keyword(spark, sf_dir):
    return _keyword_top(spark, sf_dir).select("query_id", "article_key", "ordinal", "block_type", "score", "rank")


def retrieve_vector(spark, sf_dir):
    return _vector_top(spark, sf_dir, 24).select("query_id", "id", "score", "rank")


def retrieve_hybrid(spark, sf_dir):
    """Questions of every twentieth document, with its vector; a vector is of the block whose number is the id's remainder by 3."""
    b = scratch.kept(_blocks(spark, sf_dir))
    key = F.concat(F.lit("raw/"), F.col("id").cast("string")).alias("article_key")
    v = _vector_top(spark, sf_dir, 24).select("query_id", "rank", key, (F.col("id") % 3).cast("int").alias("ordinal"))
    v = v.join(b.select("article_key", F.col("ordinal").cast("int").alias("ordinal"), "block_type"), ["article_key", "ordinal"])
    keyword = R.keyword_top(b, V.asked(spark, sf_dir), limit=16)
    return R.rrf_fusion(keyword, v, limit=8).select("query_id", "article_key", "ordinal", "block_type", "score", "rank")


def concept_confidence(spark, sf_dir):
    return C.confidence(V.concepts(spark, sf_dir)).select("slug", "confidence")


def duplicate_aliases(spark, sf_dir):
    return C.duplicate_aliases(V.concepts(spark, sf_dir)).select("alias", F.array_join("slugs", ",").alias("slugs"))


def lint(spark, sf_dir):
    return C.lint(V.concepts(spark, sf_dir))


def lint_summary(spark, sf_dir):
    return C.lint_summary(C.lint(V.concepts(spark, sf_dir)))


def importance(spark, sf_dir):
    state = V.concepts(spark, sf_dir).select("slug", F.lit(0.1).alias("importance"))
    return C.apply_importance(V.query_log(spark, sf_dir), state)


def last_queries(spark, sf_dir):
    return C.last_queries(V.query_log(spark, sf_dir))


def _assignments(spark, sf_dir):
    return K.parse_assignments(V.answers(spark, sf_dir))


def assignments(spark, sf_dir):
    return _assignments(spark, sf_dir).select(
        "article_key",
        F.array_join("existing", ",").alias("existing"),
        F.array_join(F.transform("proposed", lambda p: F.concat_ws("=", p["slug"], p["title"])), ",").alias("proposed"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def _summaries(spark, sf_dir):
    notes = V.notes(spark, sf_dir).withColumn("summary", F.col("main_content")).withColumn("content_type", F.element_at("market", 1))
    return K.source_summaries(notes, _assignments(spark, sf_dir), "2026-01-01")


def source_summaries(spark, sf_dir):
    return _summaries(spark, sf_dir).select(
        "article_key", "title", F.array_join("feeds_concepts", ",").alias("feeds"), "takeaway",
        F.size("top_idea_blocks").alias("n_ideas"), "ingested",
    )


def proposed_concepts(spark, sf_dir):
    out = K.proposed_concepts(_assignments(spark, sf_dir), V.concepts(spark, sf_dir))
    return out.select("slug", "title", "status", "definition", "synthesis", F.col("sources")[0].alias("source"), "compile_version")


def _concept_sources(spark, sf_dir):
    changed = B.changed_articles(V.notes(spark, sf_dir).select("article_key", "hash"), V.manifest(spark, sf_dir))
    return K.concept_sources(V.concepts(spark, sf_dir), K.feeds(_assignments(spark, sf_dir)), changed.where("state <> 'same'"))


def concept_sources(spark, sf_dir):
    return _concept_sources(spark, sf_dir)


def prompt_sources(spark, sf_dir):
    return K.prompt_sources(_concept_sources(spark, sf_dir))


def concept_state(spark, sf_dir):
    c = V.concepts(spark, sf_dir)
    c = c.withColumn("title", F.upper(F.col("aliases")[0])).withColumn(
        "last_compiled", F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), F.length("slug") * 20), "yyyy-MM-dd")
    )
    state = c.select("slug", F.col("compile_version").alias("conflicts"))
    out = K.concept_state(c, state, "2026-01-01")
    return out.select(
        "slug", "status", "source_count", "importance", F.round("freshness", 6).alias("freshness"),
        F.array_join("retrieval_hints", "|").alias("hints"), "conflicts",
    )


def citations(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").where("role = 'user'")
    raw = F.concat(F.lit("kb/raw/"), (F.col("conv_id") * 3 + F.col("turn")).cast("string"), F.lit("/article.md"))
    name = V.concept_of(F.col("conv_id") * 3, F.concat(F.lit("src"), (F.col("turn") % 30).cast("string")))
    page = F.concat(F.lit("wiki/concepts/"), name, F.lit(".md"))
    paths = F.array(raw, page, F.lit("outputs/x.md"))
    got = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.explode(paths).alias("path"))
    s = _summaries(spark, sf_dir).select(F.substring_index("article_key", "/", -1).alias("name"), "feeds_concepts")
    return M.resolve_citations(got, V.concepts(spark, sf_dir), s)


def unmapped_clusters(spark, sf_dir):
    s = _summaries(spark, sf_dir).select("content_type", "feeds_concepts", F.col("article_key").alias("name"))
    return M.unmapped_clusters(s).select("slug", "n", F.array_join("names", ",").alias("names"))


def idea_traceability(spark, sf_dir):
    return I.traceability(V.ideas(spark, sf_dir), V.retrieved_titles(spark, sf_dir))


def idea_novelty(spark, sf_dir):
    asked = V.asked_vectors(spark, sf_dir).select(F.col("query_id").alias("idea_id"))
    near = _vector_top(spark, sf_dir, I.NEIGHBOURS + 1).where("query_id <> id")
    out = I.novelty(asked, near.select(F.col("query_id").alias("idea_id"), "id", "score"))
    return out.fillna({"best_id": -1, "best_score": 0.0})


def idea_quality(spark, sf_dir):
    ideas = V.ideas(spark, sf_dir)
    judged = ideas.where("idea_id % 3 <> 0").select(
        "idea_id", ((F.col("idea_id") % 7) / 5.0).alias("coherence"), ((F.col("idea_id") % 4) / 4.0).alias("actionability")
    )
    return I.composite(I.traceability(ideas, V.retrieved_titles(spark, sf_dir)), judged)


def page_flags(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select(
        "page_id", E.has_math(F.col("html")).alias("has_math"), E.has_code(F.col("html")).alias("has_code"),
        E.blocked(F.col("html")).alias("blocked"), E.paywalled(F.col("html")).alias("paywalled"),
    )


def page_titles(spark, sf_dir):
    return E.extract_articles(V.table(spark, sf_dir, "pages"), "2026-01-01").select("page_id", "title", "published", "has_math")


def page_articles(spark, sf_dir):
    """Texts and fields of every page; no SQL parses markup, so tests compare with a plain reading of the markup."""
    out = E.extract_articles(V.table(spark, sf_dir, "pages"), "2026-01-01")
    return out.select(
        "page_id", "article_key", "title", "content_type", "main_content", "summary", "research_question", "signal_framework",
        "markdown", F.size("code_blocks").alias("n_code_blocks"), F.size("image_urls").alias("n_images"), "quality",
    )


def ingest_gate(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    known = E.extract_articles(pages.where("page_id % 7 = 0"), "2026-01-01").select("article_key")
    out = G.ingest_job(pages, known, V.rejected(spark, sf_dir), "2026-01-01")
    return out.select("page_id", "state", F.coalesce("rejected_reason", F.lit("")).alias("reason"))


def ingest_summary(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    known = spark.createDataFrame([], "article_key string")
    return G.run_summary(G.ingest_job(pages, known, V.rejected(spark, sf_dir), "2026-01-01"))


def note_fields(spark, sf_dir):
    n = V.notes(spark, sf_dir).select("doc_id", "title", "main_content")
    return E.heuristic_fields(n).select("doc_id", "content_type", "summary", "core_hypothesis")


def enrichment(spark, sf_dir):
    return A.parse_enrichment(V.enrichment_answers(spark, sf_dir)).select(
        "article_key", "content_type", "summary", F.array_join("market", ",").alias("market"),
        F.size("idea_blocks").alias("n_ideas"), "brainstorm_value", "confidence", "entry_rule",
        F.coalesce("error", F.lit("")).alias("error"),
    )


def enriched_notes(spark, sf_dir):
    notes = V.notes(spark, sf_dir).select("article_key", F.col("title").alias("summary"))
    out = A.merge_enrichment(notes, A.parse_enrichment(V.enrichment_answers(spark, sf_dir)), "model", "2026-01-01")
    return out.select("article_key", "summary", "llm_enriched", "llm_error")


def output_ideas(spark, sf_dir):
    return O.parse_ideas(V.outputs(spark, sf_dir)).select("output_id", "place", "title", "inspired_by", "what_is_new")


def seeded_concepts(spark, sf_dir):
    both = S.bootstrap(V.concepts(spark, sf_dir), S.seed_concepts(spark, "2026-01-01"))
    changes = V.concepts(spark, sf_dir).where("compile_version = 1").select("slug", F.lit("deprecated").alias("status"))
    return G.list_concepts(G.set_concept_status(both, changes))


def concept_pages(spark, sf_dir):
    return V.concept_pages(spark, sf_dir)


def concept_page_fields(spark, sf_dir):
    out = W.parse_concept_pages(V.concept_pages(spark, sf_dir))
    return out.select(
        "page_path", "title", "slug", "status", F.array_join("aliases", ",").alias("aliases"), "compile_version", "synthesis",
        F.size("key_idea_blocks").alias("n_ideas"), F.coalesce("error", F.lit("")).alias("error"),
    )


def page_lint(spark, sf_dir):
    return W.lint_concept_pages(W.parse_concept_pages(V.concept_pages(spark, sf_dir)))


def rethink(spark, sf_dir):
    outputs = V.outputs(spark, sf_dir)
    titles = outputs.select(F.col("output_id").alias("query_id"), F.lit("turn").alias("title"))
    near = outputs.where("output_id % 2 = 0").select(
        F.concat_ws("#", "output_id", F.lit("0")).alias("idea_id"), F.col("output_id").alias("id"), F.lit(0.9).alias("score")
    )
    return O.rethink(outputs, titles, near, O.judged_ideas(outputs, V.judge_answers(spark, sf_dir))).select(
        "idea_id", "title", "traceability", "novel", "quality"
    )


def judged_ideas(spark, sf_dir):
    return O.judged_ideas(V.outputs(spark, sf_dir), V.judge_answers(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        token_counts,
        slugs,
        url_routes,
        stages,
        facet_filter,
        sync_plan,
        blocks,
        block_counts,
        changed,
        retrieve_keyword,
        retrieve_vector,
        retrieve_hybrid,
        concept_confidence,
        duplicate_aliases,
        lint,
        lint_summary,
        importance,
        last_queries,
        assignments,
        source_summaries,
        proposed_concepts,
        concept_sources,
        prompt_sources,
        concept_state,
        citations,
        unmapped_clusters,
        idea_traceability,
        idea_novelty,
        idea_quality,
        page_flags,
        page_titles,
        page_articles,
        ingest_gate,
        ingest_summary,
        note_fields,
        enrichment,
        enriched_notes,
        output_ideas,
        seeded_concepts,
        concept_pages,
        concept_page_fields,
        page_lint,
        rethink,
        judged_ideas,
    )
}

_NOTES = """
lines AS (SELECT d.*, string_split(text, chr(10)) AS l FROM documents d),
notes AS (
  SELECT doc_id, 'raw/' || doc_id AS article_key, substr(l[1], 1, 80) AS title,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'high_value'
         WHEN quality = 1 THEN 'reviewed' ELSE 'raw' END AS status,
    lang, text, l, sha256(text) AS hash
  FROM lines LEFT JOIN labels USING (doc_id))
"""
_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_BLOCKS = f"""{_NOTES},
parts AS (
  SELECT article_key, 1 AS p, i, 'idea_blocks' AS block_type, substr(l[i + 1], 1, 120) AS text
  FROM notes, unnest([1, 2, 3]) AS r(i) WHERE status IN ('reviewed', 'high_value') AND i + 1 <= len(l)
  UNION ALL SELECT article_key, 2, 0, 'failure_modes', l[len(l)] FROM notes
  WHERE status IN ('reviewed', 'high_value') AND len(l) >= 3
  UNION ALL SELECT article_key, 3, n, 'main_content', substr({_STRIP.format("line")}, 1, 400) FROM (
    SELECT article_key, l[i] AS line, row_number() OVER (PARTITION BY article_key ORDER BY i) AS n
    FROM notes, unnest(range(1, len(l) + 1)) AS r(i)
    WHERE status IN ('reviewed', 'high_value') AND {_STRIP.format("l[i]")} <> '') WHERE n <= 6),
blocks AS (
  SELECT article_key, cast(row_number() OVER (PARTITION BY article_key ORDER BY p, i) - 1 AS int) AS ordinal,
    block_type, {_STRIP.format("text")} AS text
  FROM parts WHERE {_STRIP.format("text")} NOT IN ('', '_none_', '_pending_'))
"""
_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"
_RANK = (
    "round(score + CASE block_type WHEN 'idea_blocks' THEN 0.04::double WHEN 'failure_modes' THEN 0.02::double "
    "ELSE 0::double END, 6)"
)
_KEYWORD = f"""{_BLOCKS},
q AS (SELECT item_id AS query_id, len({_TOKENS.format("text")}) AS n, unnest({_TOKENS.format("text")}) AS token
      FROM benchmark),
b AS (SELECT article_key, ordinal, block_type, unnest({_TOKENS.format("text")}) AS token FROM blocks),
scored AS (
  SELECT query_id, article_key, ordinal, block_type,
    round(count(*) / any_value(n)::double + CASE block_type WHEN 'idea_blocks' THEN 0.25::double
          WHEN 'failure_modes' THEN 0.2::double ELSE 0::double END, 6) AS score
  FROM b JOIN q USING (token) GROUP BY query_id, article_key, ordinal, block_type),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_key ORDER BY {_RANK} DESC, ordinal) AS k FROM scored),
keyword AS (
  SELECT query_id, article_key, ordinal, block_type, score,
    cast(row_number() OVER (PARTITION BY query_id ORDER BY {_RANK} DESC, article_key, ordinal) AS int) AS rank
  FROM few WHERE k <= 3 QUALIFY rank <= 16)
"""
_ASKED = "asked AS (SELECT doc_id AS query_id, string_split(coalesce(text, ''), chr(10))[1] AS text FROM documents WHERE doc_id % 20 = 0)"
_ASKED_KEYWORD = _KEYWORD.replace("SELECT item_id AS query_id", "SELECT query_id").replace("FROM benchmark", "FROM asked")
_VECTOR = """
near AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(greatest(list_cosine_similarity(
    q.embedding::double[], e.embedding::double[]), 0), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
vector AS (
  SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int) AS rank
  FROM near QUALIFY rank <= 24)
"""
_JUDGED = """
o AS (SELECT *, conv_id * 1000 + turn AS output_id, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM conversations WHERE role <> 'user'),
places AS (SELECT *, unnest(range(0, n)) AS place FROM o),
said AS (SELECT *, output_id % 7 <> 0 AND output_id % 11 <> 0 AND NOT (output_id % 13 = 0) AS listed FROM places),
judged AS (SELECT output_id || '#' || place AS idea_id,
  CASE WHEN listed THEN CASE place WHEN 0 THEN least((output_id % 8) / 5.0::double, 1) ELSE 0.5::double END ELSE 0.5::double END AS coherence,
  CASE WHEN listed THEN CASE place WHEN 0 THEN (output_id % 4) / 4.0::double ELSE 0::double END ELSE 0.5::double END AS actionability,
  listed AS judged FROM said)
"""
_CONCEPTS = """
concepts AS (
  SELECT slug, CASE WHEN low % 3 = 2 THEN 'proposed' ELSE 'stable' END AS status, low % 3 AS loose,
    'alias ' || (low % 4) AS alias, low % 2 = 0 AS sourced, high % 2 AS compile_version, n % 2 = 0 AS filled
  FROM (SELECT 'concept-' || source || '-' || (doc_id // 200) AS slug, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high
    FROM documents GROUP BY ALL))
"""
_LINT = f"""{_CONCEPTS},
issues AS (
  SELECT 'error' AS severity, 'unsupported_claims' AS kind, slug, 'synthesis without sources' AS message
  FROM concepts WHERE status = 'stable' AND filled AND NOT sourced
  UNION ALL SELECT 'info', 'seed_stub', slug, 'seed without sources' FROM concepts
  WHERE status = 'stable' AND NOT sourced AND compile_version = 0
  UNION ALL SELECT 'warning', 'orphan_concepts', slug, 'no sources' FROM concepts
  WHERE status = 'stable' AND NOT sourced AND compile_version > 0
  UNION ALL SELECT 'warning', 'schema_empty_synthesis', slug, 'empty' FROM concepts
  WHERE status = 'stable' AND compile_version > 0 AND NOT filled
  UNION ALL SELECT 'warning', 'unsupported_bullets', slug, 'second' FROM concepts, unnest(range(loose)) WHERE status = 'stable')
"""
_LOG = """
cited AS (
  SELECT conv_id * 1000 + turn AS query_id,
    unnest(list_distinct(['concept-src' || ((conv_id + turn) % 20) || '-' || (conv_id * 3 // 200),
      'concept-src' || ((conv_id * 7 + turn) % 20) || '-' || (conv_id * 3 // 200)])) AS slug
  FROM conversations WHERE role = 'user')
"""
_ASSIGNED = """
assigned AS (
  SELECT *, 'raw/' || doc_id AS article_key, doc_id % 11 = 0 AS bad,
    CASE WHEN doc_id % 11 = 0 OR doc_id % 3 = 0 THEN '' ELSE 'concept-' || source || '-' || (doc_id // 200) END AS existing,
    CASE WHEN doc_id % 11 = 0 OR doc_id % 4 <> 0 THEN '' ELSE 'topic-' || (doc_id % 17) END AS topic
  FROM documents)
"""
_FED = f"""{_ASSIGNED}, {_CONCEPTS},
fed AS (SELECT existing AS slug, article_key, doc_id FROM assigned WHERE existing <> ''
  UNION ALL SELECT topic, article_key, doc_id FROM assigned WHERE topic <> ''),
hit AS (SELECT DISTINCT slug FROM fed WHERE (doc_id % 5 = 0 OR doc_id % 7 = 0) AND slug IN (SELECT slug FROM concepts)),
every_ AS (SELECT slug, article_key, true AS now FROM fed UNION ALL
  SELECT 'concept-' || source || '-' || (doc_id // 200), cast(min(doc_id) AS varchar), false FROM documents GROUP BY 1 HAVING min(doc_id) % 2 = 0),
sourced AS (SELECT slug, article_key, bool_or(now) AS current FROM every_ WHERE slug IN (SELECT slug FROM hit) GROUP BY ALL)
"""
_SUMMARIES = f"""{_NOTES}, {_ASSIGNED},
summaries AS (
  SELECT n.*, concat_ws(',', nullif(existing, ''), nullif(topic, '')) AS feeds, existing, topic
  FROM notes n JOIN assigned a USING (doc_id))
"""
_TRACE = """
titles AS (SELECT DISTINCT conv_id, unnest(string_split(text, ' ')[1:2]) AS title FROM conversations WHERE role = 'user'),
ideas AS (SELECT conv_id, conv_id * 1000 + turn AS idea_id, text,
  CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE substr(text, 1, 40) END AS by_ FROM conversations WHERE role <> 'user'),
traced AS (
  SELECT idea_id, round(CASE WHEN bool_or(trim(by_) <> '') THEN 0.4::double ELSE 0::double END
    + CASE WHEN bool_or(title IS NOT NULL AND contains(by_, title)) THEN 0.4::double ELSE 0::double END
    + CASE WHEN count(*) FILTER (WHERE contains(text, title)) >= 2 THEN 0.2::double ELSE 0::double END, 1) AS traceability
  FROM ideas LEFT JOIN (SELECT * FROM titles WHERE trim(title) <> '') USING (conv_id) GROUP BY idea_id)
"""
_PAGE_TITLE = r"""
titled AS (SELECT *, replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS raw FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(
  raw, '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '_+', '_', 'g'), 1, 80), '^[ ._]+', ''), '[ ._]+$', ''), '^$', 'untitled')
  AS title FROM titled)
"""
_GATE = """
gate AS (SELECT *, page_id % 5 = 0 OR url IN (SELECT url FROM pages WHERE page_id % 5 = 0) AS bad,
  url IN (SELECT url FROM pages WHERE page_id % 7 = 0) AS known FROM pages)
"""
_MATH_SQL = r"(?s)<annotation\s+encoding=[\"'']application/x-tex[\"'']>.*?</annotation>|<script\s+type=[\"'']math/tex(; mode=display)?[\"'']>.*?</script>|\$[^$\n]+?\$|\$\$[^$]+?\$\$|\\\(.*?\\\)|\\\[.*?\\\]"
_PAGES = f"""{_CONCEPTS}, low AS (SELECT 'concept-' || source || '-' || (doc_id // 200) AS slug, min(doc_id) AS low FROM documents GROUP BY 1),
written AS (SELECT c.*, low, 'wiki/concepts/' || slug || '.md' AS page_path, slug LIKE '%3-%' AS cut,
  CASE WHEN filled THEN 'text' ELSE '_pending_' END AS synthesis FROM concepts c JOIN low USING (slug)),
pages AS (SELECT page_path, 'title: ' || upper(slug) || chr(10) || 'slug: ' || slug || chr(10) || 'aliases: [Alias ' || (low % 4) || ']'
  || chr(10) || 'status: ' || status || chr(10) || 'related_concepts: []' || chr(10) || 'sources:'
  || CASE WHEN sourced THEN chr(10) || '  - ' || low ELSE ' []' END || chr(10) || 'content_types: []' || chr(10) || 'last_compiled: ' || chr(10)
  || 'compile_version: ' || compile_version || chr(10) || '---' || chr(10) || chr(10) || array_to_string(['# ' || upper(slug),
  '## Synthesis', synthesis, '## Definition', '_pending_', '## Key Idea Blocks', '- first [' || low || ']' || repeat(chr(10) || '- second', loose),
  '## Variants & Implementations', '- _none_', '## Common Combinations', '- _none_', '## Transfer Targets', '- _none_',
  CASE WHEN compile_version = 0 THEN '## Other' ELSE '## Failure Modes' END, '- _none_', '## Open Questions', '- _none_',
  '## Sources', '- _none_'], chr(10) || chr(10)) || chr(10) AS text, cut FROM written)
"""
ORACLE_SQL = {
    "concept_pages": f"WITH {_PAGES} SELECT page_path, CASE WHEN cut THEN text ELSE '---' || chr(10) || text END AS content FROM pages",
    "concept_page_fields": f"""WITH {_PAGES} SELECT page_path, CASE WHEN cut THEN '' ELSE upper(slug) END AS title,
        CASE WHEN cut THEN '' ELSE slug END AS slug, CASE WHEN cut THEN 'proposed' ELSE status END AS status,
        CASE WHEN cut THEN '' ELSE 'Alias ' || (low % 4) END AS aliases,
        cast(CASE WHEN cut THEN 0 ELSE compile_version END AS int) AS compile_version, synthesis, cast(1 + loose AS int) AS n_ideas,
        CASE WHEN cut THEN 'invalid slug' ELSE '' END AS error FROM written""",
    "page_lint": f"""WITH {_PAGES} SELECT 'error' AS severity, 'malformed_concept' AS kind, page_path, 'invalid slug' AS message
        FROM written WHERE cut
        UNION ALL SELECT 'warning', 'schema_missing_section', page_path, 'Failure Modes' FROM written WHERE NOT cut AND compile_version = 0
        UNION ALL SELECT 'warning', 'schema_empty_definition', page_path, 'definition' FROM written
        WHERE NOT cut AND status = 'stable' AND compile_version > 0
        UNION ALL SELECT 'warning', 'schema_empty_synthesis', page_path, 'synthesis' FROM written
        WHERE NOT cut AND status = 'stable' AND compile_version > 0 AND NOT filled""",
    "judged_ideas": f"WITH {_JUDGED} SELECT * FROM judged",
    "rethink": f"""WITH {_JUDGED},
        titled AS (SELECT output_id || '#0' AS idea_id, 't' || string_split(text, chr(10))[1] || 't' AS title,
          0.4::double + CASE WHEN contains('turn ' || turn, 'turn') THEN 0.4::double ELSE 0::double END AS traceability, output_id % 2 <> 0 AS novel FROM o
          UNION ALL SELECT output_id || '#1', 'other', 0::double, true FROM o WHERE conv_id % 3 = 0)
        SELECT idea_id, title, traceability, novel,
          cast(printf('%.2f', 0.3::double * traceability + 0.35::double * coherence + 0.35::double * actionability) AS double) AS quality
        FROM titled JOIN judged USING (idea_id)""",
    "page_flags": f"""SELECT page_id, regexp_matches(html, '{_MATH_SQL}') AS has_math,
        len(list_filter(regexp_extract_all(html, '(?is)<pre\\b[^>]*>(.*?)</pre>', 1),
          lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> '')) > 0 AS has_code,
        contains(html, '环境异常') OR contains(html, '去验证') OR contains(lower(html), 'secitptpage/verify') AS blocked,
        contains(lower(html), 'subscribe to read') OR contains(lower(html), 'please subscribe')
          OR contains(lower(html), 'paywall') OR contains(lower(html), 'subscribe to continue') AS paywalled FROM pages""",
    "page_titles": f"""WITH {_PAGE_TITLE} SELECT page_id, title, '' AS published,
        regexp_matches(html, '{_MATH_SQL}') AS has_math FROM named""",
    "ingest_gate": f"""WITH {_GATE} SELECT page_id, CASE WHEN bad THEN 'rejected' WHEN known THEN 'skipped' ELSE 'success' END AS state,
        CASE WHEN bad THEN 'first' ELSE '' END AS reason FROM gate""",
    "ingest_summary": f"""WITH {_GATE} SELECT count(*) AS total, count(*) FILTER (WHERE NOT bad) AS success, 0 AS skipped,
        0 AS failed, count(*) FILTER (WHERE bad) AS rejected FROM gate""",
    "note_fields": f"""WITH {_NOTES}, p AS (SELECT doc_id, lower(concat_ws(chr(10), title, text)) AS t,
          coalesce(list_filter(list_transform(l, lambda x: {_STRIP.format("x")}), lambda x: length(x) >= 8), []) AS p FROM notes)
        SELECT doc_id, CASE WHEN regexp_matches(t, '行业轮动|主题轮动|资产配置|组合配置|etf|权重|再平衡|allocation|rotation') THEN 'allocation'
          WHEN regexp_matches(t, '风控|风险控制|风险预算|仓位控制|头寸管理|波动率目标|volatility targeting|回撤控制|最大回撤|止损机制|风险平价|risk parity|hedging|对冲|regime filter') THEN 'risk_control'
          WHEN regexp_matches(t, '开仓|平仓|止损|买入|卖出|信号|调仓|回测|strategy|sharpe') THEN 'strategy'
          WHEN regexp_matches(t, '复盘|点评|周报|月报|观察|市场回顾|盘面') THEN 'market_review'
          ELSE 'methodology' END AS content_type,
        substr(array_to_string(p[1:2], chr(10) || chr(10)), 1, 400) AS summary, substr(coalesce(p[1], ''), 1, 200) AS core_hypothesis
        FROM p""",
    "enrichment": """SELECT 'raw/' || doc_id AS article_key, CASE WHEN doc_id % 5 = 0 THEN 'strategy' ELSE 'methodology' END AS content_type,
        CASE WHEN bad THEN '' ELSE source END AS summary, CASE WHEN bad OR doc_id % 2 = 1 THEN '' ELSE 'fx,bond' END AS market,
        cast(CASE WHEN bad THEN 0 WHEN trim(substr(string_split(text, chr(10))[1], 1, 20)) = '' THEN 1 ELSE 2 END AS int) AS n_ideas,
        CASE WHEN NOT bad AND doc_id % 3 = 0 THEN 'high' ELSE '' END AS brainstorm_value,
        CASE WHEN bad THEN 0::double ELSE least((doc_id % 8) / 4.0::double, 1::double) END AS confidence,
        CASE WHEN NOT bad AND doc_id % 5 = 0 THEN 'enter' ELSE '' END AS entry_rule,
        CASE WHEN bad THEN 'json_parse_error' ELSE '' END AS error FROM (SELECT *, doc_id % 13 = 0 AS bad FROM documents)""",
    "enriched_notes": f"""WITH {_NOTES} SELECT article_key, CASE WHEN doc_id % 13 = 0 THEN title ELSE d.source END AS summary,
        doc_id % 13 <> 0 AS llm_enriched, CASE WHEN doc_id % 13 = 0 THEN 'json_parse_error' ELSE '' END AS llm_error
        FROM notes JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)""",
    "output_ideas": """WITH o AS (SELECT *, conv_id * 1000 + turn AS output_id FROM conversations WHERE role <> 'user')
        SELECT output_id, 0 AS place, 't' || string_split(text, chr(10))[1] || 't' AS title, 'turn ' || turn AS inspired_by,
          '' AS what_is_new FROM o
        UNION ALL SELECT output_id, 1, 'other', '', role FROM o WHERE conv_id % 3 = 0""",
    "seeded_concepts": f"""WITH {_CONCEPTS} SELECT slug, CASE WHEN compile_version = 1 THEN 'deprecated' ELSE status END AS status,
        cast(sourced AS int) AS source_count FROM concepts
        UNION ALL SELECT slug, 'stable', 0 FROM (SELECT unnest(['factor-models', 'factor-timing', 'regime-detection', 'momentum-strategies', 'etf-rotation', 'risk-parity', 'volatility-targeting']) AS slug)""",
    "token_counts": f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens FROM documents",
    "slugs": f"""WITH {_NOTES} SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(title),
        '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM notes""",
    "url_routes": """SELECT page_id, CASE WHEN lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) LIKE '%mp.weixin.qq.com'
        THEN 'wechat' WHEN lower(string_split(url, '?')[1]) LIKE '%.pdf' THEN 'pdf' ELSE 'web' END AS route FROM pages""",
    "stages": f"WITH {_NOTES} SELECT status, count(*) AS n FROM notes GROUP BY status",
    "facet_filter": f"""WITH {_NOTES} SELECT article_key, status, title FROM notes
        WHERE status IN ('reviewed', 'high_value') AND lang IN ('en', 'de')""",
    "sync_plan": f"""WITH {_NOTES}, a AS (SELECT article_key, status, CASE WHEN text IS NULL THEN 'skip'
        WHEN status = 'rejected' THEN 'delete' WHEN status IN ('reviewed', 'high_value') THEN 'move'
        ELSE 'skip' END AS action, text IS NULL AS missing FROM notes)
        SELECT article_key, status, CASE WHEN action = 'move' THEN status ELSE '' END AS target, action,
        CASE WHEN missing THEN 'article missing' WHEN action = 'skip' THEN 'status not syncable' ELSE '' END AS reason
        FROM a""",
    "block_counts": f"""WITH {_BLOCKS} SELECT n.article_key, count(b.article_key) AS block_count
        FROM notes n LEFT JOIN blocks b USING (article_key) GROUP BY ALL""",
    "blocks": f"""WITH {_BLOCKS} SELECT replace(article_key, '/', '__') || '__' || block_type || '__' || ordinal || '__'
        || substr(sha1(article_key || '|' || block_type || '|' || ordinal || '|' || text), 1, 16) AS block_id,
        article_key, ordinal, block_type, text FROM blocks""",
    "changed": f"""WITH {_NOTES} SELECT article_key, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0
        THEN 'changed' ELSE 'same' END AS state FROM notes""",
    "retrieve_keyword": f"WITH {_KEYWORD} SELECT * FROM keyword",
    "retrieve_vector": f"WITH {_VECTOR} SELECT * FROM vector",
    "retrieve_hybrid": f"""WITH {_ASKED}, {_ASKED_KEYWORD}, {_VECTOR},
        both_ AS (SELECT query_id, article_key, ordinal, block_type, rank FROM keyword UNION ALL
          SELECT v.query_id, b.article_key, b.ordinal, b.block_type, v.rank FROM vector v
          JOIN blocks b ON b.article_key = 'raw/' || v.id AND b.ordinal = v.id % 3),
        fused AS (SELECT query_id, article_key, ordinal, block_type, round(sum(1.0::double / (60 + rank)), 9) AS score
          FROM both_ GROUP BY query_id, article_key, ordinal, block_type)
        SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY {_RANK} DESC, article_key, ordinal) AS int)
        AS rank FROM fused QUALIFY rank <= 8""",
    "concept_confidence": f"WITH {_CONCEPTS} SELECT slug, 1 / (1 + loose)::double AS confidence FROM concepts",
    "duplicate_aliases": f"""WITH {_CONCEPTS} SELECT alias, string_agg(slug, ',' ORDER BY slug) AS slugs FROM concepts
        WHERE status = 'stable' GROUP BY alias HAVING count(DISTINCT slug) > 1""",
    "lint": f"WITH {_LINT} SELECT * FROM issues",
    "lint_summary": f"""WITH {_LINT} SELECT count(*) FILTER (WHERE severity = 'error') AS errors,
        count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos,
        count(*) FILTER (WHERE severity = 'error') = 0 AS ok FROM issues""",
    "importance": f"""WITH {_CONCEPTS}, {_LOG}, n AS (SELECT slug, count(*) AS n FROM cited GROUP BY slug)
        SELECT slug, round(least(CASE WHEN c.slug IS NULL THEN 0::double ELSE 0.1::double END
        + 0.05::double * coalesce(n, 0), 1::double), 4) AS importance
        FROM concepts c FULL JOIN n USING (slug)""",
    "last_queries": f"""WITH {_LOG} SELECT slug, query_id, cast(row_number() OVER (PARTITION BY slug
        ORDER BY query_id DESC) AS int) AS place FROM cited QUALIFY place <= 5""",
    "assignments": f"""WITH {_ASSIGNED} SELECT article_key, existing, CASE WHEN topic = '' THEN '' ELSE topic || '=' ||
        CASE WHEN doc_id % 2 = 0 THEN 'Topic of ' || source ELSE topic END END AS proposed,
        CASE WHEN bad THEN 'json_parse_error' ELSE '' END AS error FROM assigned""",
    "source_summaries": f"""WITH {_SUMMARIES} SELECT article_key, coalesce(nullif({_STRIP.format("title")}, ''), article_key)
        AS title, feeds, coalesce(substr({_STRIP.format("text")}, 1, 140), '') AS takeaway,
        cast(greatest(least(len(l) - 1, 3), 0) AS int) AS n_ideas, '2026-01-01' AS ingested FROM summaries""",
    "proposed_concepts": f"""WITH {_ASSIGNED} SELECT topic AS slug, 'Topic of ' || source AS title, 'proposed' AS status,
        source AS definition, lang AS synthesis, article_key AS source, 0 AS compile_version FROM assigned
        WHERE topic <> '' QUALIFY row_number() OVER (PARTITION BY topic ORDER BY article_key) = 1""",
    "concept_sources": f"WITH {_FED} SELECT * FROM sourced",
    "prompt_sources": f"""WITH {_FED} SELECT *, cast(row_number() OVER (PARTITION BY slug
        ORDER BY current DESC, article_key) AS int) AS place FROM sourced QUALIFY place <= 8""",
    "concept_state": f"""WITH {_CONCEPTS}, c AS (SELECT *, cast(sourced AS int) AS source_count, greatest(0,
        DATE '2026-01-01' - (DATE '2025-01-01' + cast(length(slug) * 20 AS int))) AS days FROM concepts)
        SELECT slug, status, source_count, source_count / 5.0::double AS importance,
        round(exp(-ln(2::double) * days / 60), 6) AS freshness, 'Alias' || substr(alias, 6) AS hints,
        cast(compile_version AS int) AS conflicts FROM c""",
    "citations": f"""WITH {_SUMMARIES}, {_CONCEPTS},
        asked AS (SELECT conv_id * 1000 + turn AS query_id, cast(conv_id * 3 + turn AS varchar) AS name,
          'concept-src' || (turn % 30) || '-' || (conv_id * 3 // 200) AS page FROM conversations WHERE role = 'user'),
        fed AS (SELECT query_id, unnest([existing, topic]) AS name FROM asked a JOIN summaries s ON s.article_key = 'raw/' || a.name)
        SELECT query_id, 'source' AS kind, name FROM asked
        UNION SELECT query_id, 'concept', name FROM fed WHERE name <> ''
        UNION SELECT query_id, CASE WHEN page IN (SELECT slug FROM concepts) THEN 'concept' ELSE 'source' END, page FROM asked""",
    "unmapped_clusters": f"""WITH {_SUMMARIES}, loose AS (SELECT coalesce(nullif(trim(lang), ''), 'uncategorized') || '-cluster'
        AS slug, article_key FROM summaries WHERE feeds = '')
        SELECT slug, count(*) AS n, array_to_string(list_sort(list(article_key))[1:8], ',') AS names
        FROM loose GROUP BY slug HAVING count(*) >= 2""",
    "idea_traceability": f"WITH {_TRACE} SELECT * FROM traced",
    "idea_novelty": f"""WITH {_VECTOR}, best AS (SELECT query_id, id, score FROM vector WHERE id <> query_id AND rank <= 6
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1)
        SELECT vec_id AS idea_id, id IS NULL AS novel, coalesce(id, -1) AS best_id,
        coalesce(round(score, 3), 0) AS best_score FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0)
        LEFT JOIN (SELECT * FROM best WHERE score >= 0.75) ON query_id = vec_id""",
    "idea_quality": f"""WITH {_TRACE} SELECT idea_id, cast(printf('%.2f', 0.3::double * traceability
        + 0.35::double * CASE WHEN idea_id % 3 = 0 THEN 0.5::double ELSE least((idea_id % 7) / 5.0::double, 1::double) END
        + 0.35::double * CASE WHEN idea_id % 3 = 0 THEN 0.5::double ELSE (idea_id % 4) / 4.0::double END) AS double) AS quality
        FROM traced""",
}
