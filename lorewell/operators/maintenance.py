"""What the query log and the state of concepts say about the knowledge base."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import concepts
from lorewell.sources import scratch
from lorewell.sources.store import Change, Store

# When a concept has too few sources, or is stale.
FEW_SOURCES = 2
STALE = 0.4
# What a concept's name is searched with, and asked about.
SEARCH_WORDS = ("survey", "backtest", "应用")
QUESTIONS = (("What recent thinking has emerged on ", "?"), ("How does ", " combine with neighboring concepts?"))
#: Names that a cluster of unmapped articles shows.
SHOWN = 8


def resolve_citations(retrieved: DataFrame, concept_rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """``retrieved(query_id, path)`` as distinct (query_id, kind, name) rows.

    A path under wiki/concepts or raw gives a name.  A concept's name is a cited
    concept; another is a cited source, and all concepts it feeds are cited
    too.  Other paths are ignored.
    """
    page = F.regexp_extract("path", r"wiki/concepts/([^/]+)\.md\z", 1)
    raw = F.regexp_extract("path", r"(?:^|/)raw/([^/]+)", 1)
    named = retrieved.select("query_id", F.when(page != "", page).otherwise(raw).alias("name")).where("name <> ''").distinct()
    known = concept_rows.select(F.col("slug").alias("name")).distinct()
    hits = named.join(known, "name", "left_semi").select("query_id", F.lit("concept").alias("kind"), "name")
    sources = named.join(known, "name", "left_anti")
    fed = sources.join(summaries.select("name", "feeds_concepts"), "name").select(
        "query_id", F.lit("concept").alias("kind"), F.explode("feeds_concepts").alias("name")
    )
    cited = sources.select("query_id", F.lit("source").alias("kind"), "name")
    return hits.unionByName(fed).unionByName(cited).distinct()


def unmapped_clusters(summaries: DataFrame, at_least: int = 2) -> DataFrame:
    """(slug, n, names): articles that feed no concept, by content type, with their first names.

    The count is summed before the shuffle and the window keeps ``SHOWN`` rows
    a task before it, so a type that most articles share is no large group.
    """
    kind = F.coalesce(F.nullif(F.trim("content_type"), F.lit("")), F.lit("uncategorized"))
    loose = summaries.where(F.size("feeds_concepts") == 0).select(
        F.concat(F.regexp_replace(kind, "_", "-"), F.lit("-cluster")).alias("slug"), "name"
    )
    sizes = loose.groupBy("slug").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    w = Window.partitionBy("slug").orderBy("name")
    first = loose.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= SHOWN)
    names = first.groupBy("slug").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return sizes.join(names, "slug")


def suggestions(state: DataFrame) -> DataFrame:
    """(slug, kind, text): three searches for each stable concept of few sources, two questions for each stale one."""
    name = F.regexp_replace("slug", "-", " ")

    def say(kind: str, before: str, after: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(before), name, F.lit(after)).alias("text"))

    searches = [say("under_supported", "", f" {word}") for word in SEARCH_WORDS]
    questions = [say("stale", before, after) for before, after in QUESTIONS]
    few = F.when(F.col("source_count") <= FEW_SOURCES, F.array(*searches))
    stale = F.when(F.col("freshness") <= STALE, F.array(*questions))
    rows = state.where("status = 'stable'").select(
        "slug", F.explode(F.flatten(F.filter(F.array(few, stale), lambda x: x.isNotNull()))).alias("s")
    )
    return rows.select("slug", "s.kind", "s.text")


def query_improvements(log: DataFrame, n: int = 5) -> DataFrame:
    """(slug, queries): the last ``n`` questions that cite each concept, in the log's order."""
    return questions(concepts.last_queries(log, n).join(log.select("query_id", "query"), "query_id"))


def merged_last(last: DataFrame, log: DataFrame, n: int = 5) -> DataFrame:
    """(slug, query_id, query): of each concept the last ``n`` of ``last``, rows of this kind, and of what ``log`` brings.

    The last n of two parts of a log are among the last n of each, so the
    result is the same however a log is split, and in whatever order its parts
    come; a row that comes twice counts once.
    """
    cited = log.select(F.explode(F.array_distinct("cited_concepts")).alias("slug"), "query_id", "query")
    rows = last.select("slug", "query_id", "query").unionByName(cited).distinct()
    w = Window.partitionBy("slug").orderBy(F.desc("query_id"), "query")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


#: The table of a store of last questions, and its key.
STORED = {"last": "slug"}


def keep_last(store: Store, log: DataFrame, n: int = 5) -> DataFrame:
    """Merge a part of the log into the stored last questions, reading only the buckets it cites; the stored table is returned."""
    log = scratch.kept(log.select("query_id", "query", "cited_concepts"))
    cited = scratch.kept(log.select(F.explode("cited_concepts").alias("slug")).distinct())
    buckets = [r.b for r in cited.select(store.bucket(F.col("slug")).alias("b")).distinct().collect()]
    last = store.read("last", only=buckets)
    if last is None:
        last = log.sparkSession.createDataFrame([], "slug string, query_id long, query string")
    if buckets:
        store.commit({"last": Change(merged_last(last.join(cited, "slug", "left_semi"), log, n), cited)})
    return store.read("last") if buckets or store.read("last") is not None else last


def questions(last: DataFrame) -> DataFrame:
    """(slug, queries) of rows of :func:`merged_last`, in the log's order."""
    pairs = F.array_sort(F.collect_list(F.struct("query_id", "query")))  # at most n a concept
    return last.groupBy("slug").agg(pairs["query"].alias("queries"))


def latest_output(outputs: DataFrame) -> DataFrame:
    """The newest of ``outputs(query_id, mode, written_at, path)`` of each query and mode; of equal times the last path."""
    newest = F.max(F.struct("written_at", "path")).alias("_o")
    return outputs.groupBy("query_id", "mode").agg(newest).select("query_id", "mode", "_o.written_at", "_o.path")


class Maintained(NamedTuple):
    """What a maintenance run finds, and the state after it."""

    improvements: DataFrame
    clusters: DataFrame
    suggestions: DataFrame
    counts: DataFrame
    state: DataFrame


def maintain_job(log: DataFrame, summaries: DataFrame, state: DataFrame, apply: bool = False) -> Maintained:
    """Questions to take up, clusters of articles without a concept, searches and questions; and how many of each.

    With ``apply`` the last three questions of each known concept become hints of at most 40 characters.
    """
    improvements, clusters, said = query_improvements(log), unmapped_clusters(summaries), suggestions(state)
    kinds = said.select("slug", "kind").distinct()
    counts = (
        improvements.agg(F.count("*").alias("query_improvements"))
        .crossJoin(clusters.agg(F.count("*").alias("new_concepts")))
        .crossJoin(
            kinds.agg(
                F.count_if(F.col("kind") == "under_supported").alias("under_supported"), F.count_if(F.col("kind") == "stale").alias("stale")
            )
        )  # one row each
    )
    if apply:
        last = concepts.last_queries(log, 3).join(log.select("query_id", "query"), "query_id")
        hints = last.select("slug", F.col("query_id").alias("place"), T.query_slug(F.col("query"), 40).alias("hint"))
        state = concepts.with_hints(state, hints)
    return Maintained(improvements, clusters, said, counts, state)
