"""All lint rules as one table of issues, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators import concepts as C
from lorewell.operators import wiki_pages as W

# Kinds of issues that a recompilation can mend.
FIXABLE = ("unsupported_bullets", "unsupported_claims", "schema_missing_section", "schema_empty_synthesis", "schema_empty_definition")
SHOWN = 10


def stale_sources(state: DataFrame, articles: DataFrame) -> DataFrame:
    """Issues of ``state(path, content_hash, feeds_concepts)`` against ``articles(article_key, hash)``: gone or changed."""
    now = articles.select(F.col("article_key").alias("path"), F.col("hash").alias("_now"))
    both = state.select("path", "content_hash", "feeds_concepts").join(now, "path", "left")
    gone = F.col("_now").isNull()
    feeds = F.concat(F.lit("source changed, feeds "), F.array_join("feeds_concepts", ", "))
    return both.where(gone | (F.col("_now") != F.col("content_hash"))).select(
        F.lit("warning").alias("severity"),
        F.when(gone, "orphan_sources").otherwise("stale_concepts").alias("kind"),
        "path",
        F.when(gone, "source is gone").otherwise(feeds).alias("message"),
    )


def orphan_summaries(summaries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Issues of ``summaries(name, feeds_concepts)`` that feed no stable concept."""
    stable = concepts.where("status = 'stable'").select(F.col("slug").alias("_slug")).distinct()
    fed = summaries.select("name", F.explode("feeds_concepts").alias("_slug")).join(stable, "_slug", "left_semi").select("name").distinct()
    return summaries.select("name", "feeds_concepts").join(fed, "name", "left_anti").select(
        F.lit("info").alias("severity"),
        F.lit("orphan_sources").alias("kind"),
        F.concat(F.lit("wiki/sources/"), "name", F.lit(".md")).alias("path"),
        F.concat(F.lit("feeds no stable concept: "), F.array_join("feeds_concepts", ", ")).alias("message"),
    )


def _of_concepts(issues: DataFrame) -> DataFrame:
    path = F.concat(F.lit("wiki/concepts/"), "slug", F.lit(".md"))
    return issues.select("severity", "kind", path.alias("path"), "message")


def _of_pages(issues: DataFrame) -> DataFrame:
    return issues.select("severity", "kind", F.col("page_path").alias("path"), "message")


def lint_job(
    concepts: DataFrame,
    concept_pages: DataFrame,
    source_pages: DataFrame,
    summaries: DataFrame,
    source_state: DataFrame,
    articles: DataFrame,
) -> DataFrame:
    """(severity, kind, path, message): every rule's issues in one table.

    ``concepts`` and ``summaries`` are the good rows of the parsed pages.
    """
    aliases = C.duplicate_aliases(concepts).select(
        F.lit("warning").alias("severity"),
        F.lit("duplicate_aliases").alias("kind"),
        F.lit("wiki/concepts").alias("path"),
        F.concat("alias", F.lit(": "), F.array_join("slugs", ", ")).alias("message"),
    )
    # empty texts are judged on the pages, where the sections are
    of_rows = C.lint(concepts).where("kind <> 'schema_empty_synthesis'")
    parts = [
        _of_concepts(of_rows),
        _of_pages(W.lint_concept_pages(concept_pages)),
        _of_pages(W.lint_source_pages(source_pages)),
        stale_sources(source_state, articles),
        orphan_summaries(summaries, concepts),
        aliases,
    ]
    return reduce(DataFrame.unionByName, parts)


def issue_sample(issues: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first ``n`` issues of each severity by kind, path and message, with ``place`` from 1."""
    w = Window.partitionBy("severity").orderBy("kind", "path", "message")
    return issues.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def fix_worklist(issues: DataFrame, concepts: DataFrame, source_state: DataFrame, articles: DataFrame) -> DataFrame:
    """(slug, article_key): concepts with an issue that a recompilation can mend, and the present sources that feed them."""
    slug = F.regexp_extract("path", r"(?:^|/)concepts/([^/]+)\.md\z", 1)
    broken = issues.where(F.col("kind").isin(*FIXABLE)).select(slug.alias("slug")).where("slug <> ''").distinct()
    broken = broken.join(concepts.select("slug").distinct(), "slug", "left_semi")
    feeding = source_state.select(F.col("path").alias("article_key"), F.explode(F.array_distinct("feeds_concepts")).alias("slug"))
    return feeding.join(broken, "slug", "left_semi").join(articles.select("article_key").distinct(), "article_key", "left_semi").select(
        "slug", "article_key"
    )


def repaired(concepts: DataFrame, results: DataFrame) -> DataFrame:
    """``concepts`` with ``results(slug, synthesis, definition, error)`` of the worklist: status, sources and date stay, the version goes up."""
    good = results.where("error IS NULL").select("slug", F.col("synthesis").alias("_s"), F.col("definition").alias("_d"))
    out = concepts.join(good.withColumn("_ok", F.lit(True)), "slug", "left")
    ok = F.coalesce("_ok", F.lit(False))
    return out.withColumns(
        {
            "synthesis": F.when(ok, F.col("_s")).otherwise(F.col("synthesis")),
            "definition": F.when(ok, F.col("_d")).otherwise(F.col("definition")),
            "compile_version": F.col("compile_version") + ok.cast("int"),
        }
    ).drop("_s", "_d", "_ok")
