"""Queries over the compiled wiki and the composite jobs, and their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import blocks as B
from lorewell.operators import compiling as K
from lorewell.operators import cells as Y
from lorewell.operators import concepts as C
from lorewell.operators import edges as D
from lorewell.operators import enrichment as A
from lorewell.operators import ideas as I
from lorewell.operators import indexing as X
from lorewell.operators import ingest as G
from lorewell.operators import lint_changes as H
from lorewell.operators import linting as L
from lorewell.operators import maintenance as M
from lorewell.operators import notes as N
from lorewell.operators import postings as P
from lorewell.operators import retrieval as R
from lorewell.operators import wiki_pages as W
from lorewell.plans import views as V
from lorewell.sources import scratch
from lorewell.sources.store import Change, Store
from lorewell.streaming import feedback as S

TODAY = "2026-01-01"


def _no_state(spark) -> DataFrame:
    return spark.createDataFrame([], "slug string, conflicts int")


def _state(spark, sf_dir):
    return K.concept_state(C.confidence(V.topics(spark, sf_dir)), _no_state(spark), TODAY)


def topic_state(spark, sf_dir):
    s = _state(spark, sf_dir)
    memory = T.memory_score(F.col("confidence"), F.col("importance"), F.col("freshness"), F.col("source_count"), F.col("conflicts"))
    return s.select(
        "slug", "status", "source_count", F.round("confidence", 6).alias("confidence"), F.round("importance", 6).alias("importance"),
        F.round("freshness", 6).alias("freshness"), F.round(memory, 6).alias("memory"), F.array_join("retrieval_hints", "|").alias("hints"),
    )


def article_notes(spark, sf_dir):
    n = N.to_notes(V.article_files(spark, sf_dir))
    return n.select(
        "article_key", "title", "status", "summary", F.array_join("market", "|").alias("market"),
        F.coalesce(F.array_join("idea_blocks", "|"), F.lit("none")).alias("ideas"), "main_content",
    )


def article_note_blocks(spark, sf_dir):
    out = B.article_blocks(N.filter_notes(N.to_notes(V.article_files(spark, sf_dir))))
    return out.select("article_key", "ordinal", "block_type", "text", "status", "kb_layer")


def _wiki_blocks(spark, sf_dir):
    return B.build_wiki_blocks(V.topics(spark, sf_dir), V.topic_summaries(spark, sf_dir), _state(spark, sf_dir))


def wiki_blocks(spark, sf_dir):
    return _wiki_blocks(spark, sf_dir).select(
        "article_key", "block_id", "block_type", "text", "content_type", "brainstorm_value", "status",
        F.coalesce("slug", F.lit("")).alias("slug"), F.round(F.coalesce("confidence", F.lit(-1.0)), 6).alias("confidence"),
        F.coalesce("source_count", F.lit(-1)).alias("source_count"),
    )


def _index_inputs(spark, sf_dir) -> tuple:
    """Notes, concepts, summaries and state; and the index and manifest of an earlier run."""
    files = V.article_files(spark, sf_dir)
    notes = N.filter_notes(N.to_notes(files))
    id_ = F.substring_index("article_key", "/", -1).try_cast("long")
    old = files.where(id_ % 5 != 0)
    right = F.when(id_ % 7 == 0, "stale").otherwise(B.index_hash(F.col("content")))
    manifest = old.select("article_key", right.alias("hash"), F.lit(1).alias("block_count"), F.lit("reviewed").alias("source_dir"))
    index = old.select("article_key", F.concat(F.lit("old-"), "article_key").alias("block_id"), F.lit("article").alias("kb_layer"))
    topics = scratch.kept(V.topics(spark, sf_dir))
    state = K.concept_state(C.confidence(topics), _no_state(spark), TODAY)
    return notes, topics, V.topic_summaries(spark, sf_dir), state, index, manifest


def _lengths(texts):
    return [[float(len(t))] for t in texts]


def _index_run(spark, sf_dir) -> X.Indexed:
    return X.index_job(*_index_inputs(spark, sf_dir), _lengths, scratch.kept)


def _stored_index(spark, sf_dir) -> X.Indexed:
    """The same run on an index that is stored: the earlier one is committed, then what changed."""
    *made, index, manifest = _index_inputs(spark, sf_dir)
    store = Store(spark, _new_folder(spark), X.STORED)
    index = index.withColumn("embedding", F.lit(None).cast("array<float>"))
    store.commit({"blocks": Change(index), "manifest": Change(manifest)})
    return X.index_into(store, *made, _lengths)


def index_run(spark, sf_dir):
    return _index_rows(_index_run(spark, sf_dir).index)


def _index_rows(out):
    size = F.coalesce(F.get("embedding", F.lit(0)).cast("long"), F.lit(-1))
    return out.select("article_key", "kb_layer", F.when(size < 0, F.col("block_id")).otherwise("").alias("old"), size.alias("size"))


def stored_index(spark, sf_dir):
    return _index_rows(_stored_index(spark, sf_dir).index)


def stored_manifest(spark, sf_dir):
    return _stored_index(spark, sf_dir).manifest.select("article_key", "hash", "block_count", "source_dir")


def index_manifest(spark, sf_dir):
    return _index_run(spark, sf_dir).manifest.select("article_key", "hash", "block_count", "source_dir")


def index_summary(spark, sf_dir):
    return _index_run(spark, sf_dir).summary


def _hits(spark, sf_dir):
    return R.concepts_by_words(V.topics(spark, sf_dir), V.asked(spark, sf_dir), _state(spark, sf_dir))


def concepts_by_words(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "slug", "score", "rank")


def concepts_by_vector(spark, sf_dir):
    """Every 25th vector is a topic's; the query set are the ids that 20 divides."""
    e = V.table(spark, sf_dir, "embeddings")
    slug = F.concat(F.lit("topic-"), F.floor(F.col("vec_id") / V.TOPIC).cast("string"))
    kind = F.when(F.col("vec_id") % V.TOPIC == 0, "wiki_concept").otherwise("article")
    named = e.select(F.col("vec_id").alias("id"), "embedding", slug.alias("slug"), kind.alias("kb_layer"))
    t = V.topics(spark, sf_dir)
    index = named.join(t.select("slug", "status"), "slug")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = R.vector_scores(R.stable_concept_blocks(index), asked, R.FETCH_CONCEPTS * R.CONCEPT_TOP_K)
    return R.concepts_by_vector(near, index, t, _state(spark, sf_dir)).select("query_id", "slug", "score", "rank")


def _note_blocks(spark, sf_dir):
    return B.build_blocks(N.filter_notes(V.notes(spark, sf_dir)))


def _retrieved(spark, sf_dir):
    asked = V.asked(spark, sf_dir)
    keyword = R.keyword_top(_note_blocks(spark, sf_dir), asked, limit=2 * R.TOP_K)
    return R.retrieve(asked, keyword, None, _hits(spark, sf_dir), V.topics(spark, sf_dir), mode="keyword")


def retrieve_wiki_first(spark, sf_dir):
    return _retrieved(spark, sf_dir).select("query_id", "place", "layer", "name", "ordinal", "block_type", "mode")


def _retrieved_by(spark, sf_dir, mode):
    """Concepts first, by vector where a question has one, then blocks by ``mode``."""
    asked, vectors = V.asked(spark, sf_dir), V.asked_vectors(spark, sf_dir)
    topics = scratch.kept(V.topics(spark, sf_dir))
    state = K.concept_state(C.confidence(topics), _no_state(spark), TODAY)
    blocks = scratch.kept(_note_blocks(spark, sf_dir))
    index = scratch.kept(V.vector_index(spark, sf_dir, blocks, topics))
    concept_near = R.vector_scores(R.stable_concept_blocks(index), vectors, R.FETCH_CONCEPTS * R.CONCEPT_TOP_K)
    by_vector = R.concepts_by_vector(concept_near, index, topics, state)
    hits = scratch.kept(R.concepts_first(by_vector, R.concepts_by_words(topics, asked, state)))
    near = R.vector_scores(index, vectors, R.FETCH_BLOCKS * R.TOP_K)
    vector = R.vector_top(near, index, blocks, limit=2 * R.TOP_K)
    keyword = R.keyword_top(blocks, asked, limit=2 * R.TOP_K)
    out = R.retrieve(asked, keyword, vector, hits, topics, mode=mode)
    return out.withColumn("warning", F.coalesce("warning", F.lit("")))


def retrieve_wiki_vector(spark, sf_dir):
    return _retrieved_by(spark, sf_dir, "vector")


def retrieve_wiki_hybrid(spark, sf_dir):
    return _retrieved_by(spark, sf_dir, "hybrid")


def _new_folder(spark) -> str:
    return f"{scratch.folder(spark)}/lorewell-index/{uuid.uuid4().hex}"


def retrieve_postings(spark, sf_dir):
    """The benchmark's questions by a stored inverted index of all blocks."""
    path = _new_folder(spark)
    P.write_postings(_note_blocks(spark, sf_dir), path)
    out = P.search(spark, path, V.queries(spark, sf_dir), limit=2 * R.TOP_K)
    return out.select("query_id", "article_key", "ordinal", "block_type", "score", "rank")


def retrieve_vector_cells(spark, sf_dir):
    """Every twentieth vector's neighbours by an index of cells over all vectors."""
    path, e = _new_folder(spark), V.table(spark, sf_dir, "embeddings")
    Y.write_cells(e.select(F.col("vec_id").alias("id"), "embedding"), path, cells=64)
    return Y.search(spark, path, V.asked_vectors(spark, sf_dir), R.FETCH_BLOCKS * R.TOP_K).select("query_id", "id", "score", "rank")


def contexts(spark, sf_dir):
    got = _retrieved(spark, sf_dir)
    of_articles = _note_blocks(spark, sf_dir).select(F.col("article_key").alias("name"), "ordinal", "block_type", "text")
    body = F.concat_ws("\n\n", F.filter(F.array("synthesis", "definition"), lambda x: x != ""))
    of_concepts = V.topics(spark, sf_dir).select(
        F.col("slug").alias("name"), F.lit(0).alias("ordinal"), F.lit("wiki_concept").alias("block_type"), body.alias("text")
    )
    texts = of_articles.unionByName(of_concepts)
    rows = got.join(texts, ["name", "ordinal", "block_type"]).select(
        "query_id", "place", F.col("name").alias("title"), F.col("name").alias("path"), F.lit("").alias("content_type"), "block_type", "text"
    )
    return R.format_context(rows)


def _issues(spark, sf_dir):
    t, s = V.topics(spark, sf_dir), V.topic_summaries(spark, sf_dir)
    articles = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("article_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")
    )
    pages = W.parse_concept_pages(W.render_concept_pages(t))
    source_pages = W.parse_source_pages(W.render_source_pages(s))
    return L.lint_job(t, pages, source_pages, s, V.source_state(spark, sf_dir), articles), t, articles


def lint_all(spark, sf_dir):
    return _issues(spark, sf_dir)[0]


def lint_changed(spark, sf_dir):
    """The same table by a run over an older wiki and one over what changed since."""
    t, s = scratch.kept(V.topics(spark, sf_dir)), V.topic_summaries(spark, sf_dir)
    articles = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("article_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")
    )
    k = F.substring_index("slug", "-", -1).cast("long")
    older = t.where(k % 11 != 3).withColumn("status", F.when(k % 7 == 1, "deprecated").otherwise(F.col("status")))
    state = V.source_state(spark, sf_dir)
    store = Store(spark, _new_folder(spark), H.STORED)
    H.lint_changes(store, W.render_concept_pages(older), W.render_source_pages(s.where("name % 10 <> 1")), state, articles.limit(0))
    return H.lint_changes(store, W.render_concept_pages(t), W.render_source_pages(s), state, articles)


def lint_sample(spark, sf_dir):
    return L.issue_sample(_issues(spark, sf_dir)[0])


def fix_worklist(spark, sf_dir):
    issues, t, articles = _issues(spark, sf_dir)
    return L.fix_worklist(issues, t, V.source_state(spark, sf_dir), articles)


def topic_pages_again(spark, sf_dir):
    """Pages written and read again give the concepts that they were written from, blank texts aside."""
    out = W.parse_concept_pages(W.render_concept_pages(V.topics(spark, sf_dir)))
    return out.select(
        "slug", "status", "compile_version", F.size("sources").alias("n_sources"), F.size("key_idea_blocks").alias("n_ideas"),
        F.size("variants").alias("n_variants"), F.array_join("failure_modes", "|").alias("failure_modes"), "synthesis",
    )


def index_groups(spark, sf_dir):
    return K.index_groups(V.topics(spark, sf_dir))


def index_header(spark, sf_dir):
    return K.index_header(V.topics(spark, sf_dir), V.topic_summaries(spark, sf_dir))


def _compiled(spark, sf_dir, with_edges: bool = False) -> K.Compiled:
    notes = V.notes(spark, sf_dir).withColumn("summary", F.lit("")).withColumn("content_type", F.element_at("market", 1))
    state = V.source_state(spark, sf_dir).where("path NOT LIKE '%gone%'")
    topic = F.concat(F.lit("topic-"), F.floor(F.substring_index("article_key", "/", -1).try_cast("long") / 25).cast("string"))
    id_ = F.substring_index("article_key", "/", -1).try_cast("long")
    proposal = F.array(F.struct(F.concat(F.lit("new-"), (id_ % 10).cast("string")).alias("slug"), F.lit("N").alias("title")))
    answer = F.to_json(F.struct(F.array(topic).alias("existing_concepts"), F.when(id_ % 6 == 0, proposal).alias("proposed_new_concepts")))

    def assign(changed):
        return changed.select("article_key", F.when(id_ % 14 == 0, "no json").otherwise(answer).alias("raw"))

    def recompile(prompts):
        n = F.regexp_extract("slug", r"(\d+)\z", 1).cast("long")
        return prompts.groupBy("slug").agg(F.count("*").alias("n")).select(
            "slug", F.concat(F.lit("from "), F.col("n").cast("string")).alias("synthesis"), F.lit("").alias("definition"),
            F.when(n % 4 == 1, "timeout").alias("error"),
        )

    topics = scratch.kept(V.topics(spark, sf_dir))
    nothing = spark.createDataFrame([], topics.schema)
    edges = D.from_lists(topics, scratch.kept) if with_edges else None
    return K.compile_job(
        notes, topics, V.topic_summaries(spark, sf_dir).where("name % 8 <> 0"), state, _no_state(spark), nothing,
        assign, recompile, scratch.kept, TODAY, edges=edges,
    )


def compiled_concepts(spark, sf_dir):
    c = _compiled(spark, sf_dir).concepts
    return c.select("slug", "status", "compile_version", F.size("sources").alias("n_sources"), "synthesis", "last_compiled")


def compiled_edges(spark, sf_dir):
    """The same compilation with sources in an edge table, whose rows are counted."""
    out = _compiled(spark, sf_dir, with_edges=True)
    n = D.rows_of(out.edges).groupBy("slug").agg(F.count("*").cast("int").alias("n_sources"))
    c = out.concepts.join(n, "slug", "left").fillna(0, ["n_sources"])
    return c.select("slug", "status", "compile_version", "n_sources", "synthesis", "last_compiled")


def compile_report(spark, sf_dir):
    return _compiled(spark, sf_dir).report


def latest_output(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    out = c.select(F.col("conv_id").alias("query_id"), F.col("role").alias("mode"), F.col("turn").alias("written_at"), F.substring("text", 1, 9).alias("path"))
    return M.latest_output(out)


def feedback(spark, sf_dir):
    out = C.apply_feedback(V.asked_log(spark, sf_dir), _state(spark, sf_dir))
    return out.select("slug", "status", F.round("importance", 4).alias("importance"), F.array_join("retrieval_hints", "|").alias("hints"))


def _log_parts(spark, sf_dir) -> list[DataFrame]:
    """The log in three parts, by conversation; the second has rows of the first again."""
    log = scratch.kept(V.asked_log(spark, sf_dir))
    edges = log.agg(F.expr("percentile_approx(log_id, array(0.4, 0.6))")).first()[0] or [0, 0]
    low, high = edges
    at = F.col("log_id")
    return [log.where(at <= low), log.where((at <= high) & ((at > low) | (at % 2 == 0))), log.where(at > high)]


def feedback_stream(spark, sf_dir):
    """The feedback as a stream of three batches into a stored state."""
    store = Store(spark, _new_folder(spark), S.STORED)
    S.begin(store, _state(spark, sf_dir))
    for part in _log_parts(spark, sf_dir):
        part.coalesce(1).write.mode("append").parquet(f"{store.root}-log")
    log = spark.readStream.schema(S.LOG).option("maxFilesPerTrigger", 1).parquet(f"{store.root}-log")
    S.stream_feedback(log, store.root, f"{store.root}-checkpoint").awaitTermination()
    out = store.read("state")
    return out.select("slug", "status", F.round("importance", 4).alias("importance"), F.array_join("retrieval_hints", "|").alias("hints"))


def last_questions(spark, sf_dir):
    """The last questions of each concept, kept from the log's parts."""
    store = Store(spark, _new_folder(spark), M.STORED)
    for part in _log_parts(spark, sf_dir):
        out = M.keep_last(store, part.withColumnRenamed("log_id", "query_id"))
    return M.questions(out).select("slug", F.array_join("queries", "|").alias("queries"))


def _maintained(spark, sf_dir) -> M.Maintained:
    log = V.asked_log(spark, sf_dir).dropDuplicates(["log_id"]).withColumnRenamed("log_id", "query_id")
    return M.maintain_job(log, V.topic_summaries(spark, sf_dir), _state(spark, sf_dir), apply=True)


def maintain_counts(spark, sf_dir):
    return _maintained(spark, sf_dir).counts


def maintain_suggestions(spark, sf_dir):
    return _maintained(spark, sf_dir).suggestions


def query_improvements(spark, sf_dir):
    return _maintained(spark, sf_dir).improvements.select("slug", F.array_join("queries", "|").alias("queries"))


def _enriched(spark, sf_dir) -> A.Enriched:
    notes = V.notes(spark, sf_dir).withColumn("content_type", F.lit("strategy")).withColumn("summary", F.col("title"))
    notes = notes.withColumn("llm_enriched", F.col("doc_id") % 10 == 0)
    answers = V.enrichment_answers(spark, sf_dir).select("article_key", "raw")

    def ask(prompts):
        return prompts.join(answers, "article_key").select("article_key", "raw", F.lit(None).cast("string").alias("error"))

    return A.enrich_job(notes, ask, scratch.kept, "model", TODAY)


def enrich_run(spark, sf_dir):
    return _enriched(spark, sf_dir).notes.select("article_key", "summary", "llm_enriched", F.coalesce("llm_error", F.lit("")).alias("llm_error"))


def enrich_summary(spark, sf_dir):
    return _enriched(spark, sf_dir).summary.select("total", "success", "failed", "skipped")


def enrichment_prompts(spark, sf_dir):
    return A.enrichment_prompts(A.select_for_enrichment(V.notes(spark, sf_dir).withColumn("llm_enriched", F.lit(False))))


def review_queue(spark, sf_dir):
    return G.numbered(G.review_queue(V.notes(spark, sf_dir).withColumn("summary", F.col("main_content"))), "article_key", scratch.kept)


def idea_neighbours(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = R.vector_scores(e.select(F.col("vec_id").alias("id"), "embedding"), asked, I.NEIGHBOURS)
    out = I.closest(asked.select(F.col("query_id").alias("idea_id")), near.select(F.col("query_id").alias("idea_id"), "id", "score"))
    return out.select("idea_id", F.size("matches").alias("n"), F.array_join(F.transform("matches", lambda m: m["id"].cast("string")), ",").alias("ids"))


def text_functions(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    day = F.concat(
        F.lit("on "), (2000 + F.col("doc_id") % 30).cast("string"), F.when(F.col("doc_id") % 2 == 0, "年").otherwise("/"),
        (F.col("doc_id") % 12 + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, "月").otherwise("-"), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(" x"),
    )
    text = F.concat(F.col("source"), F.lit(" \t\r\n\n\n\n a: "), F.col("lang"), F.lit("  "))
    return d.select(
        "doc_id", T.normalize_date(F.when(F.col("doc_id") % 5 == 0, "no date").otherwise(day)).alias("day"), T.clean_text(text).alias("clean"),
        T.query_slug(text).alias("query_slug"), T.output_slug(text).alias("output_slug"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        topic_state, article_notes, article_note_blocks, wiki_blocks, index_run, index_manifest, index_summary, stored_index, stored_manifest, concepts_by_words,
        concepts_by_vector, retrieve_wiki_first, retrieve_wiki_vector, retrieve_wiki_hybrid, retrieve_postings,
        retrieve_vector_cells, contexts, lint_all, lint_changed, lint_sample, fix_worklist, topic_pages_again, index_groups,
        index_header, compiled_concepts, compiled_edges, compile_report, latest_output, feedback, feedback_stream, last_questions, maintain_counts, maintain_suggestions,
        query_improvements, enrich_run, enrich_summary, enrichment_prompts, review_queue, idea_neighbours, text_functions,
    )
}
