"""DuckDB counterparts of the queries in :mod:`lorewell.plans.wiki`, written from what the tables say."""

from __future__ import annotations

from lorewell.plans import registry as base

_NL = "chr(10)"
_ANCHORED = r"len(list_filter(string_split(regexp_extract(b, '\[([^\[\]]*)\]\s*$', 1), ','), lambda x: trim(x) <> '')) > 0"
_TOPICS = rf"""
docw AS (SELECT doc_id, lang, source, doc_id // 25 AS k,
  array_to_string(string_split(replace(coalesce(text, ''), chr(10), ' '), ' ')[1:5], ' ') AS words FROM documents),
bul AS (SELECT *, words || CASE doc_id % 3 WHEN 0 THEN ' [' || doc_id || ', ' || source || ']' WHEN 1 THEN ' []' ELSE '' END AS bullet
  FROM docw),
grouped AS (SELECT k, arg_min(words, doc_id) AS first_words, arg_max(words, doc_id) AS last_words, arg_min(lang, doc_id) AS lang0,
  coalesce(list(bullet ORDER BY doc_id) FILTER (WHERE doc_id % 5 < 2), []) AS ideas,
  coalesce(list(bullet ORDER BY doc_id) FILTER (WHERE doc_id % 5 = 2), []) AS variants,
  coalesce(list(bullet ORDER BY doc_id) FILTER (WHERE doc_id % 25 = 4), []) AS common,
  coalesce(list(bullet ORDER BY doc_id) FILTER (WHERE doc_id % 5 = 3 AND k % 2 = 0), []) AS failures,
  coalesce(list(bullet ORDER BY doc_id) FILTER (WHERE doc_id % 25 = 9), []) AS questions,
  coalesce(list('raw/' || doc_id ORDER BY doc_id) FILTER (WHERE doc_id % 25 < k % 7), []) AS sources
  FROM bul GROUP BY k),
named AS (SELECT *, 'topic-' || k AS slug, 'Topic ' || k || ' ' || string_split(first_words, ' ')[1] AS title,
  CASE WHEN k % 8 = 5 THEN 'proposed' WHEN k % 8 = 6 THEN 'deprecated' ELSE 'stable' END AS status,
  CASE WHEN k % 4 = 3 THEN '_pending_' WHEN k % 4 = 2 THEN '' ELSE first_words END AS synthesis,
  CASE WHEN k % 5 = 4 THEN '' ELSE last_words END AS definition,
  cast(k % 3 AS int) AS compile_version, len(sources) AS n_sources,
  CASE WHEN k % 6 = 0 THEN NULL ELSE lang0 END AS kind,
  CASE WHEN k % 10 <> 9 THEN DATE '2025-06-01' + cast(k % 200 AS int) END AS compiled,
  list_concat(list_concat(ideas, variants), failures) AS judged FROM grouped),
topic_scores AS (SELECT *, CASE WHEN len(judged) = 0 THEN CASE WHEN n_sources > 0 THEN 0.5::double ELSE 0.1::double END
    ELSE len(list_filter(judged, lambda b: {_ANCHORED})) / len(judged)::double END AS confidence,
  least(n_sources / 5.0::double, 1::double) AS importance,
  CASE WHEN compiled IS NULL THEN 0::double ELSE exp(-ln(2::double) * greatest(DATE '2026-01-01' - compiled, 0) / 60) END AS freshness,
  ['Alias ' || (k % 9), upper(lang0), trim(title)] AS hints FROM named),
topics AS (SELECT *, greatest(0.35::double * confidence + 0.25::double * importance + 0.2::double * freshness
  + 0.2::double * (1 - exp(-n_sources / 4.0::double)), 0::double) AS memory FROM topic_scores)
"""
_FILES = """
files AS (SELECT *, 'raw/' || doc_id AS article_key, doc_id % 11 = 0 AS bare,
  'x' || string_split(coalesce(text, ''), chr(10))[1] || 'x' AS main,
  CASE WHEN doc_id % 11 = 0 OR doc_id % 4 > 1 THEN 'raw' WHEN doc_id % 4 = 0 THEN 'reviewed' ELSE 'high_value' END AS status
  FROM documents),
contents AS (SELECT *, CASE WHEN bare THEN '' ELSE '---' || chr(10) || 'title: ' || CASE WHEN doc_id % 6 = 0 THEN '' ELSE '"Doc ' || doc_id || '"' END
  || chr(10) || 'status: ' || CASE doc_id % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN '"high_value"' WHEN 2 THEN 'raw' ELSE '' END
  || chr(10) || 'market: ' || CASE doc_id % 3 WHEN 0 THEN '["' || lang || '", "fx"]' WHEN 1 THEN lang ELSE '[a, b]' END
  || chr(10) || 'idea_blocks: ' || CASE WHEN doc_id % 5 = 0 THEN '[one idea, no json]' ELSE '["i' || doc_id || '", "two: b"]' END
  || chr(10) || 'summary: sum: ' || source || chr(10) || 'no colon here' || chr(10) || '---' || chr(10) END
  || '# T' || chr(10) || chr(10) || '## Main Content' || chr(10) || chr(10) || main || chr(10) || chr(10) || '## Next' || chr(10) || chr(10)
  || 'end' || chr(10) AS content FROM files),
file_blocks AS (
  SELECT article_key, doc_id, 0 AS ordinal, 'summary' AS block_type, 'sum: ' || source AS text, status FROM files WHERE status <> 'raw'
  UNION ALL SELECT article_key, doc_id, 1, 'idea_blocks', 'i' || doc_id, status FROM files WHERE status <> 'raw' AND doc_id % 5 <> 0
  UNION ALL SELECT article_key, doc_id, 2, 'idea_blocks', 'two: b', status FROM files WHERE status <> 'raw' AND doc_id % 5 <> 0
  UNION ALL SELECT article_key, doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 3 END, 'main_content', rtrim(substr(main, 1, 400)), status
  FROM files WHERE status <> 'raw')
"""
_WIKI_BLOCKS = f"""{_TOPICS},
wiki AS (
  SELECT 'wiki/concepts/' || slug || '.md' AS article_key, 'wiki_concept' AS block_type,
    array_to_string(list_filter([synthesis, definition, array_to_string(ideas, chr(10)), array_to_string(variants, chr(10)),
      array_to_string(common, chr(10)), array_to_string(failures, chr(10))], lambda x: x <> ''), chr(10) || chr(10)) AS text,
    coalesce(kind, '') AS content_type, 'high' AS brainstorm_value, status, slug, round(confidence, 6) AS confidence,
    cast(n_sources AS int) AS source_count FROM topics
  UNION ALL SELECT 'wiki/sources/' || doc_id || '.md', 'wiki_source',
    'take ' || array_to_string(string_split(replace(coalesce(text, ''), chr(10), ' '), ' ')[1:4], ' ') || CASE WHEN source = '' THEN '' ELSE ' · ' || source END,
    lang, CASE WHEN doc_id % 13 = 0 THEN 'best' WHEN doc_id % 2 = 0 THEN 'high' ELSE '' END, 'stable', '', -1, -1 FROM documents),
wiki_rows AS (SELECT *, replace(article_key, '/', '__') || '__' || block_type || '__0__'
  || substr(sha1(article_key || '|' || block_type || '|0|' || text), 1, 16) AS block_id FROM wiki WHERE trim(text) <> '')
"""
_ASKED = base._ASKED
_HITS = f"""
words AS (SELECT slug, memory, unnest({base._TOKENS.format("title || ' ' || array_to_string(hints, ' ') || ' ' || substr(definition, 1, 200)")}) AS token
  FROM topics WHERE status = 'stable'),
asked_words AS (SELECT query_id, unnest({base._TOKENS.format("text")}) AS token FROM asked),
by_words AS (SELECT query_id, slug, round(count(*) + 2 * any_value(memory), 6) AS score FROM words JOIN asked_words USING (token) GROUP BY ALL),
hits AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS int) AS rank FROM by_words QUALIFY rank <= 3)
"""
_ASKED_KEYWORD = base._ASKED_KEYWORD
_RETRIEVED = f"""{_ASKED}, {_TOPICS}, {_HITS}, {_ASKED_KEYWORD},
cited AS (SELECT DISTINCT query_id, unnest(sources) AS article_key FROM hits JOIN topics USING (slug)),
both_ AS (SELECT query_id, 0 AS l, slug AS name, 0 AS ordinal, 'wiki_concept' AS block_type, rank FROM hits
  UNION ALL SELECT query_id, 1, article_key, ordinal, block_type, rank FROM keyword ANTI JOIN cited USING (query_id, article_key)),
retrieved AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY l, rank) AS int) AS place FROM both_ QUALIFY place <= 8)
"""
_ISSUES = f"""{_TOPICS},
feeding AS (SELECT doc_id, 'raw/' || doc_id AS path, doc_id % 7 = 0 AS old, ['topic-' || (doc_id // 25), 'topic-' || (doc_id // 25 + 1)] AS feeds
  FROM documents WHERE doc_id % 9 <> 0),
alias_rows AS (SELECT slug, lower(trim(unnest(['Alias ' || (k % 9), upper(lang0)]))) AS alias FROM topics WHERE status = 'stable'),
issues AS (
  SELECT 'warning' AS severity, 'unsupported_bullets' AS kind, 'wiki/concepts/' || slug || '.md' AS path, b AS message
  FROM (SELECT slug, unnest(list_concat(list_concat(list_concat(ideas, variants), list_concat(common, failures)), questions)) AS b
    FROM topics WHERE status = 'stable') WHERE NOT ({_ANCHORED})
  UNION ALL SELECT 'error', 'unsupported_claims', 'wiki/concepts/' || slug || '.md', 'synthesis without sources' FROM topics
    WHERE status = 'stable' AND trim(synthesis) <> '' AND NOT starts_with(trim(synthesis), '_pending') AND n_sources = 0
  UNION ALL SELECT 'info', 'seed_stub', 'wiki/concepts/' || slug || '.md', 'seed without sources' FROM topics
    WHERE status = 'stable' AND n_sources = 0 AND compile_version = 0
  UNION ALL SELECT 'warning', 'orphan_concepts', 'wiki/concepts/' || slug || '.md', 'no sources' FROM topics
    WHERE status = 'stable' AND n_sources = 0 AND compile_version > 0
  UNION ALL SELECT 'warning', 'schema_empty_synthesis', 'wiki/concepts/' || slug || '.md', 'synthesis' FROM topics
    WHERE status = 'stable' AND compile_version > 0 AND (trim(synthesis) = '' OR starts_with(trim(synthesis), '_pending'))
  UNION ALL SELECT 'warning', 'schema_empty_definition', 'wiki/concepts/' || slug || '.md', 'definition' FROM topics
    WHERE status = 'stable' AND compile_version > 0 AND (trim(definition) = '' OR starts_with(trim(definition), '_pending'))
  UNION ALL SELECT 'warning', 'schema_invalid_enum', 'wiki/sources/' || doc_id || '.md', 'best' FROM documents WHERE doc_id % 13 = 0
  UNION ALL SELECT 'warning', 'stale_concepts', path, 'source changed, feeds ' || array_to_string(feeds, ', ') FROM feeding WHERE old
  UNION ALL SELECT 'warning', 'orphan_sources', 'raw/gone-' || doc_id, 'source is gone' FROM documents WHERE doc_id % 50 = 0
  UNION ALL SELECT 'info', 'orphan_sources', 'wiki/sources/' || doc_id || '.md',
    'feeds no stable concept: ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'topic-' || (doc_id // 25) END FROM documents
    WHERE doc_id % 3 = 0 OR 'topic-' || (doc_id // 25) NOT IN (SELECT slug FROM topics WHERE status = 'stable')
  UNION ALL SELECT 'warning', 'duplicate_aliases', 'wiki/concepts', alias || ': ' || string_agg(slug, ', ' ORDER BY slug)
    FROM (SELECT DISTINCT alias, slug FROM alias_rows) GROUP BY alias HAVING count(*) > 1)
"""
_COMPILED = f"""{_TOPICS},
seen AS (SELECT *, 'raw/' || doc_id AS article_key, 'topic-' || (doc_id // 25) AS topic, 'topic-' || (doc_id // 25 + 1) AS next_topic,
  doc_id % 9 = 0 OR doc_id % 7 = 0 OR doc_id % 8 = 0 AS todo, doc_id % 14 = 0 AS bad FROM documents),
proposals AS (SELECT 'new-' || (doc_id % 10) AS slug, article_key FROM seen WHERE todo AND NOT bad AND doc_id % 6 = 0),
fed AS (SELECT topic AS slug, article_key FROM seen WHERE todo AND NOT bad UNION SELECT slug, article_key FROM proposals
  UNION SELECT topic, article_key FROM seen WHERE NOT todo UNION SELECT next_topic, article_key FROM seen WHERE NOT todo),
hit AS (SELECT DISTINCT topic AS slug FROM seen WHERE todo AND NOT bad),
every_ AS (SELECT slug, article_key FROM fed UNION SELECT slug, unnest(sources) FROM topics),
sets AS (SELECT slug, count(*) AS n FROM every_ SEMI JOIN hit USING (slug) GROUP BY slug),
results AS (SELECT slug, n, cast(regexp_extract(slug, '([0-9]+)$', 1) AS bigint) % 4 = 1 AS failed FROM sets)
"""
_LOG = """
n_topics AS (SELECT max(doc_id) // 25 + 3 AS n FROM documents),
asked_log AS (SELECT conv_id * 1000 + turn AS log_id, 'Q ' || conv_id || ' - t' || turn || '?' AS query, 'q_' || conv_id || '_t' || turn AS hint,
  unnest(list_distinct(['topic-' || ((conv_id + turn) % n), 'topic-' || ((conv_id * 7 + turn) % n)])) AS slug
  FROM conversations, n_topics WHERE role = 'user')
"""
_MATH = "round(greatest(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 0), 6)"

ORACLE_SQL = {
    "topic_state": f"""WITH {_TOPICS} SELECT slug, status, cast(n_sources AS int) AS source_count, round(confidence, 6) AS confidence,
        round(importance, 6) AS importance, round(freshness, 6) AS freshness, round(memory, 6) AS memory,
        array_to_string(hints, '|') AS hints FROM topics""",
    "article_notes": f"""WITH {_FILES} SELECT article_key, CASE WHEN bare OR doc_id % 6 = 0 THEN article_key ELSE 'Doc ' || doc_id END AS title,
        status, CASE WHEN bare THEN '' ELSE 'sum: ' || source END AS summary,
        CASE WHEN bare THEN '' WHEN doc_id % 3 = 0 THEN lang || '|fx' WHEN doc_id % 3 = 1 THEN lang ELSE '[a, b]' END AS market,
        CASE WHEN bare OR doc_id % 5 = 0 THEN 'none' ELSE 'i' || doc_id || '|two: b' END AS ideas, main AS main_content FROM files""",
    "article_note_blocks": f"""WITH {_FILES} SELECT article_key, cast(ordinal AS int) AS ordinal, block_type, text, status, 'article' AS kb_layer
        FROM file_blocks""",
    "wiki_blocks": f"""WITH {_WIKI_BLOCKS} SELECT article_key, block_id, block_type, text, content_type, brainstorm_value, status, slug, confidence,
        source_count FROM wiki_rows""",
    "index_run": f"""WITH {_WIKI_BLOCKS}, {_FILES}
        SELECT article_key, 'article' AS kb_layer, '' AS old, length(text) AS size FROM file_blocks WHERE doc_id % 5 = 0 OR doc_id % 7 = 0
        UNION ALL SELECT article_key, block_type, '', length(text) FROM wiki_rows
        UNION ALL SELECT article_key, 'article', 'old-' || article_key, -1 FROM files
        WHERE doc_id % 5 <> 0 AND NOT (status <> 'raw' AND doc_id % 7 = 0)""",
    "index_manifest": f"""WITH {_FILES}, n AS (SELECT article_key, cast(count(*) AS int) AS n FROM file_blocks GROUP BY article_key)
        SELECT article_key, sha256('1' || content) AS hash, n AS block_count, status AS source_dir FROM contents JOIN n USING (article_key)
        WHERE doc_id % 5 = 0 OR doc_id % 7 = 0
        UNION ALL SELECT article_key, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256('1' || content) END, 1, 'reviewed' FROM contents
        WHERE doc_id % 5 <> 0 AND NOT (status <> 'raw' AND doc_id % 7 = 0)""",
    "index_summary": f"""WITH {_FILES} SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 5 = 0 OR doc_id % 7 = 0) AS success,
        count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS skipped, cast(0 AS bigint) AS failed FROM files WHERE status <> 'raw'""",
    "concepts_by_words": f"WITH {_ASKED}, {_TOPICS}, {_HITS} SELECT * FROM hits",
    "concepts_by_vector": f"""WITH {_TOPICS},
        near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, t.slug, t.memory, {_MATH} AS sim
          FROM embeddings e JOIN topics t ON t.k = e.vec_id // 25 AND e.vec_id % 25 = 0 AND t.status = 'stable', embeddings q WHERE q.vec_id % 20 = 0),
        few AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 12),
        both_ AS (SELECT query_id, slug, round(0.5::double * sim + 0.5::double * memory, 6) AS score FROM few)
        SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug) AS int) AS rank FROM both_ QUALIFY rank <= 3""",
    "retrieve_wiki_first": f"""WITH {_RETRIEVED} SELECT query_id, place, CASE l WHEN 0 THEN 'concept' ELSE 'article' END AS layer, name,
        cast(ordinal AS int) AS ordinal, block_type, 'keyword' AS mode FROM retrieved""",
    "contexts": f"""WITH {_RETRIEVED},
        texts AS (SELECT article_key AS name, ordinal, block_type, text FROM blocks UNION ALL SELECT slug, 0, 'wiki_concept',
          array_to_string(list_filter([synthesis, definition], lambda x: x <> ''), chr(10) || chr(10)) FROM topics)
        SELECT query_id, string_agg('[Context ' || place || '] [' || CASE l WHEN 0 THEN 'Wiki Concept' ELSE 'Article' END || ']' || chr(10)
          || 'Title: ' || name || chr(10) || 'Path: ' || name || chr(10) || 'Content Type: ' || chr(10) || 'Block Type: ' || block_type
          || chr(10) || 'Content: ' || text, chr(10) || chr(10) ORDER BY place) AS context
        FROM retrieved JOIN texts USING (name, ordinal, block_type) GROUP BY query_id""",
    "lint_all": f"WITH {_ISSUES} SELECT * FROM issues",
    "lint_sample": f"""WITH {_ISSUES} SELECT *, cast(row_number() OVER (PARTITION BY severity ORDER BY kind, path, message) AS int) AS place
        FROM issues QUALIFY place <= 10""",
    "fix_worklist": f"""WITH {_ISSUES}, broken AS (SELECT DISTINCT regexp_extract(path, 'concepts/(.*)[.]md$', 1) AS slug FROM issues
          WHERE path LIKE 'wiki/concepts/%' AND kind IN ('unsupported_bullets', 'unsupported_claims', 'schema_empty_synthesis', 'schema_empty_definition'))
        SELECT slug, path AS article_key FROM (SELECT path, unnest(feeds) AS slug FROM feeding) SEMI JOIN broken USING (slug)""",
    "topic_pages_again": f"""WITH {_TOPICS} SELECT slug, status, compile_version, cast(n_sources AS int) AS n_sources, cast(len(ideas) AS int) AS n_ideas,
        cast(len(variants) AS int) AS n_variants, array_to_string(failures, '|') AS failure_modes,
        CASE WHEN synthesis = '' THEN '_pending_' ELSE synthesis END AS synthesis FROM topics""",
    "index_groups": f"""WITH {_TOPICS} SELECT status AS section, CASE WHEN status = 'stable' THEN coalesce(kind, 'uncategorized') ELSE '' END
        AS content_type, slug, cast(n_sources AS int) AS source_count FROM topics WHERE status IN ('stable', 'proposed')""",
    "index_header": f"""WITH {_TOPICS} SELECT count(*) FILTER (WHERE status = 'stable') AS stable, count(*) FILTER (WHERE status = 'proposed')
        AS proposed, (SELECT count(*) FROM documents) AS sources FROM topics""",
    "compiled_concepts": f"""WITH {_COMPILED}
        SELECT slug, CASE WHEN r.failed = false THEN 'stable' ELSE status END AS status,
          cast(compile_version + CASE WHEN r.failed = false THEN 1 ELSE 0 END AS int) AS compile_version,
          cast(CASE WHEN r.failed = false THEN r.n ELSE n_sources END AS int) AS n_sources,
          CASE WHEN r.failed = false THEN 'from ' || least(r.n, 8) ELSE synthesis END AS synthesis,
          CASE WHEN r.failed = false THEN '2026-01-01' ELSE coalesce(cast(compiled AS varchar), '') END AS last_compiled
        FROM topics LEFT JOIN results r USING (slug)
        UNION ALL SELECT slug, 'proposed', 0, 1, NULL, NULL FROM (SELECT DISTINCT slug FROM proposals)""",
    "compile_report": f"""WITH {_COMPILED} SELECT count(*) FILTER (WHERE todo) AS sources_written, count(*) FILTER (WHERE todo) AS concepts_assigned,
        count(*) FILTER (WHERE todo AND NOT bad AND doc_id % 6 = 0) AS concepts_proposed, count(*) FILTER (WHERE todo AND bad) AS assign_failed,
        (SELECT count(*) FROM results WHERE NOT failed) AS concepts_recompiled, (SELECT count(*) FROM results WHERE failed) AS recompile_failed,
        count(*) FILTER (WHERE NOT todo) AS skipped,
        count(*) FILTER (WHERE todo AND bad) + (SELECT count(*) FROM results WHERE failed) AS errors FROM seen""",
    "latest_output": """SELECT conv_id AS query_id, role AS mode, turn AS written_at, substr(text, 1, 9) AS path FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, substr(text, 1, 9) DESC) = 1""",
    "feedback": f"""WITH {_TOPICS}, {_LOG}, n AS (SELECT slug, count(*) AS n FROM asked_log GROUP BY slug),
        last AS (SELECT slug, hint, log_id FROM asked_log QUALIFY row_number() OVER (PARTITION BY slug ORDER BY log_id DESC) <= 12),
        fresh AS (SELECT slug, list(hint ORDER BY log_id) AS fresh FROM last GROUP BY slug),
        both_ AS (SELECT slug, coalesce(status, 'proposed') AS status, coalesce(importance, 0) + 0.05::double * coalesce(n, 0) AS importance,
          list_concat(coalesce(hints, []), coalesce(fresh, [])) AS hints FROM topics FULL JOIN n USING (slug) LEFT JOIN fresh USING (slug))
        SELECT slug, status, round(least(importance, 1), 4) AS importance, array_to_string(hints[-12:], '|') AS hints FROM both_""",
    "maintain_counts": f"""WITH {_TOPICS}, {_LOG} SELECT (SELECT count(DISTINCT slug) FROM asked_log) AS query_improvements,
        (SELECT count(*) FROM (SELECT lang FROM documents WHERE doc_id % 3 = 0 GROUP BY lang HAVING count(*) >= 2)) AS new_concepts,
        count(*) FILTER (WHERE status = 'stable' AND n_sources <= 2) AS under_supported,
        count(*) FILTER (WHERE status = 'stable' AND freshness <= 0.4) AS stale FROM topics""",
    "maintain_suggestions": f"""WITH {_TOPICS} SELECT slug, 'under_supported' AS kind, 'topic ' || k || unnest([' survey', ' backtest', ' 应用']) AS text
        FROM topics WHERE status = 'stable' AND n_sources <= 2
        UNION ALL SELECT slug, 'stale', unnest(['What recent thinking has emerged on topic ' || k || '?',
          'How does topic ' || k || ' combine with neighboring concepts?']) FROM topics WHERE status = 'stable' AND freshness <= 0.4""",
    "query_improvements": f"""WITH {_LOG}, last AS (SELECT * FROM asked_log QUALIFY row_number() OVER (PARTITION BY slug ORDER BY log_id DESC) <= 5)
        SELECT slug, string_agg(query, '|' ORDER BY log_id) AS queries FROM last GROUP BY slug""",
    "enrich_run": f"""WITH {base._NOTES}, j AS (SELECT n.*, d.source, n.status = 'raw' AND n.doc_id % 10 <> 0 AS asked, n.doc_id % 13 = 0 AS bad
          FROM notes n JOIN (SELECT doc_id, source FROM documents) d USING (doc_id))
        SELECT article_key, CASE WHEN asked AND NOT bad THEN source ELSE title END AS summary,
          CASE WHEN asked THEN NOT bad ELSE doc_id % 10 = 0 END AS llm_enriched,
          CASE WHEN asked AND bad THEN 'json_parse_error' ELSE '' END AS llm_error FROM j""",
    "enrich_summary": f"""WITH {base._NOTES}, j AS (SELECT status = 'raw' AND doc_id % 10 <> 0 AS asked, doc_id % 13 = 0 AS bad FROM notes)
        SELECT count(*) AS total, count(*) FILTER (WHERE asked AND NOT bad) AS success, count(*) FILTER (WHERE asked AND bad) AS failed,
        count(*) FILTER (WHERE NOT asked) AS skipped FROM j""",
    "enrichment_prompts": f"""WITH {base._NOTES} SELECT article_key, 'title: ' || title || chr(10) || chr(10) || 'main_content:' || chr(10)
        || substr(text, 1, 8000) || chr(10) || chr(10) || 'code_blocks:' || chr(10) AS prompt FROM notes WHERE status = 'raw'""",
    "review_queue": f"""WITH {base._NOTES} SELECT article_key, title, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END
        AS summary, row_number() OVER (ORDER BY article_key) AS number FROM notes WHERE status = 'raw'""",
    "idea_neighbours": f"""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_MATH} AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
        few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM near QUALIFY r <= 5)
        SELECT query_id AS idea_id, cast(count(*) AS int) AS n, string_agg(cast(id AS varchar), ',' ORDER BY r) AS ids FROM few GROUP BY query_id""",
    "text_functions": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE (2000 + doc_id % 30) || '-' || lpad(cast(doc_id % 12 + 1 AS varchar), 2, '0')
        || '-' || lpad(cast(doc_id % 28 + 1 AS varchar), 2, '0') END AS day, source || chr(10) || chr(10) || ' a: ' || lang AS clean,
        lower(source || '_a_' || lang) AS query_slug, lower(source || '_a_' || lang) AS output_slug FROM documents""",
}
# concepts by vector where a question has some, else by words; blocks by vector, without the concepts' sources
_BY_MODES = f"""{_ASKED}, {_TOPICS}, {_HITS.replace("hits AS", "word_hits AS")}, {_ASKED_KEYWORD},
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_MATH} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
concept_near AS (SELECT p.query_id, p.id, t.slug, t.memory, p.score FROM pairs p JOIN topics t
  ON t.k = p.id // 25 AND p.id % 25 = 0 AND t.status = 'stable' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 12),
vector_hits AS (SELECT query_id, slug, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(0.5::double * score + 0.5::double * memory, 6) DESC, slug)
  AS int) AS rank FROM concept_near QUALIFY rank <= 3),
hits AS (SELECT * FROM vector_hits UNION ALL
  SELECT query_id, slug, rank FROM word_hits ANTI JOIN vector_hits USING (query_id)),
cited AS (SELECT DISTINCT query_id, unnest(sources) AS article_key FROM hits JOIN topics USING (slug)),
indexed AS (SELECT * FROM pairs LEFT JOIN blocks ON id % 25 <> 0 AND article_key = 'raw/' || id AND ordinal = id % 3
  WHERE block_type IS NOT NULL OR (id % 25 = 0 AND id // 25 IN (SELECT k FROM topics))),
block_near AS (SELECT * FROM indexed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 24),
vector AS (SELECT query_id, article_key, ordinal, block_type, cast(row_number() OVER (PARTITION BY query_id ORDER BY {base._RANK} DESC, article_key, ordinal)
  AS int) AS rank FROM block_near WHERE block_type IS NOT NULL QUALIFY rank <= 16),
near_ AS (SELECT * FROM vector ANTI JOIN cited USING (query_id, article_key)),
fused AS (SELECT query_id, article_key, ordinal, block_type, round(sum(1.0::double / (60 + rank)), 9) AS score FROM (
  SELECT query_id, article_key, ordinal, block_type, rank FROM keyword SEMI JOIN near_ USING (query_id) UNION ALL SELECT * FROM near_) GROUP BY ALL),
hybrid AS (SELECT query_id, article_key, ordinal, block_type, cast(row_number() OVER (PARTITION BY query_id ORDER BY {base._RANK} DESC, article_key, ordinal)
  AS int) AS rank FROM fused QUALIFY rank <= 8)
"""


def _by_mode(mode: str, main: str) -> str:
    return f"""WITH {_BY_MODES},
        listed AS (SELECT *, '{mode}' AS mode FROM {main} UNION ALL
          SELECT query_id, article_key, ordinal, block_type, rank, 'keyword' FROM keyword ANTI JOIN near_ USING (query_id)),
        both_ AS (SELECT query_id, 0 AS l, slug AS name, 0 AS ordinal, 'wiki_concept' AS block_type, rank, NULL AS mode FROM hits
          UNION ALL SELECT query_id, 1, article_key, ordinal, block_type, rank, mode FROM listed),
        placed AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY l, rank) AS int) AS place,
          coalesce(max(mode) OVER (PARTITION BY query_id), 'keyword') AS resolved FROM both_)
        SELECT query_id, place, CASE l WHEN 0 THEN 'concept' ELSE 'article' END AS layer, name, ordinal, block_type, resolved AS mode,
          CASE WHEN resolved <> '{mode}' THEN '{mode} retrieval returned no results; fell back to keyword' ELSE '' END AS warning
        FROM placed WHERE place <= 8 AND query_id IN (SELECT query_id FROM asked)"""


ORACLE_SQL |= {"retrieve_wiki_vector": _by_mode("vector", "near_"), "retrieve_wiki_hybrid": _by_mode("hybrid", "hybrid")}
# the same results by stores that are written in several runs
ORACLE_SQL |= {
    "stored_index": ORACLE_SQL["index_run"],
    "stored_manifest": ORACLE_SQL["index_manifest"],
    "feedback_stream": ORACLE_SQL["feedback"],
    "last_questions": ORACLE_SQL["query_improvements"],
    "lint_changed": ORACLE_SQL["lint_all"],
    "compiled_edges": ORACLE_SQL["compiled_concepts"],
    "retrieve_postings": base.ORACLE_SQL["retrieve_keyword"],
    "retrieve_vector_cells": base.ORACLE_SQL["retrieve_vector"],
}
