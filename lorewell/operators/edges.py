"""Sources of concepts as a table of chunks, for concepts that very many articles feed.

A concept's row lists its first sources; all of them are in the edge table
(slug, chunk, articles), at most ``CHUNK`` articles a row.  Places within a
concept come from range partitions and prefix sums, so no concept's sources are
in one row, one group or one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Articles in a row of the edge table, and those that a concept's own row lists.
CHUNK = 1000
LISTED = 1000


def placed(rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows(slug, article_key)`` with ``place`` within the concept, from 0 in the order of keys, and ``total``.

    ``keep`` writes a table and reads it again, so that all steps see the same ranges.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = rows.select("slug", "article_key").distinct().repartitionByRange(n, "slug", "article_key")
    ranged = keep(ranged.sortWithinPartitions("slug", "article_key").withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    parts = ranged.groupBy("_part", "slug").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("slug").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")
    parts = keep(parts.select("_part", "slug", base, F.sum("_n").over(Window.partitionBy("slug")).alias("total")))
    joined = ranged.join(parts, ["_part", "slug"])
    return joined.select("slug", "article_key", (F.col("_at") + F.col("_base")).alias("place"), "total")


def chunks(rows: DataFrame) -> DataFrame:
    """(slug, chunk, articles) of :func:`placed` rows."""
    each = rows.groupBy("slug", F.expr(f"place div {CHUNK}").alias("chunk"))
    return each.agg(F.array_sort(F.collect_list("article_key")).alias("articles"))  # CHUNK at most


def rows_of(edges: DataFrame) -> DataFrame:
    """(slug, article_key) of an edge table."""
    return edges.select("slug", F.explode("articles").alias("article_key"))


def from_lists(concepts: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edge table of concepts that list all their sources."""
    return chunks(placed(concepts.select("slug", F.explode("sources").alias("article_key")), keep))


def first_sources(rows: DataFrame, listed: int = LISTED) -> DataFrame:
    """(slug, sources, source_basenames, source_count) of :func:`placed` rows: the first sources of each concept, and how many there are."""
    few = rows.where(F.col("place") < listed)
    out = few.groupBy("slug").agg(F.array_sort(F.collect_list("article_key")).alias("sources"), F.max("total").alias("source_count"))
    names = F.transform("sources", lambda k: F.substring_index(k, "/", -1))
    return out.select("slug", "sources", names.alias("source_basenames"), F.col("source_count").cast("int").alias("source_count"))


def merged(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """The edge table with the concepts of ``changed(slug, chunk, articles)`` replaced."""
    return edges.join(changed.select("slug").distinct(), "slug", "left_anti").unionByName(changed)
