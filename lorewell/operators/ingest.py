"""The gate between extracted pages and the article table, and changes of status afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import extraction as E

ALLOWED_STATUS = ("reviewed", "high_value", "rejected")
#: Into how many groups the rows of one key are split, since a third of all pages may be copies of one.
PARTS = 64
#: Place of entries that come after all others.
LATER = 2**62
CONCEPT_STATUS = ("stable", "deprecated", "deleted")


def clean_urls(lines: DataFrame, pasted: bool = False) -> DataFrame:
    """(place, url) of ``lines(place, line)``: separators at the ends, blanks and # comments go; the first of equals stays.

    A pasted text also splits at commas and semicolons.
    """
    parts = F.split("line", "[,;，；\n]") if pasted else F.array("line")
    out = lines.select("place", F.posexplode(parts).alias("part", "url"))
    out = out.withColumn("url", F.regexp_replace(T.strip(F.col("url")), r"^[;；,，]+|[;；,，]+\z", ""))
    out = out.where((F.col("url") != "") & ~F.col("url").startswith("#"))
    return out.groupBy("url").agg(F.min(F.struct("place", "part")).alias("p")).select("p.place", "url")


def flag_rejected(candidates: DataFrame, rejected: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``rejected_reason``: null unless an entry ``(place, source_url, title, reason)`` has the same address or title.

    Of several entries the first by place counts.  Each key keeps one entry
    before the joins, so candidates are never multiplied.
    """
    if force:
        return candidates.withColumn("rejected_reason", F.lit(None).cast("string"))

    def firsts(key: str, name: str) -> DataFrame:
        known = rejected.where(F.coalesce(F.col(key), F.lit("")) != "")
        return known.groupBy(F.col(key).alias(f"_{name}")).agg(F.min(F.struct("place", "reason")).alias(f"_by_{name}"))

    out = candidates.join(firsts("source_url", "url"), F.col("url") == F.col("_url"), "left")
    out = out.join(firsts("title", "title"), F.col("title") == F.col("_title"), "left")
    first = F.least("_by_url", "_by_title")
    out = out.withColumn("rejected_reason", F.when(first.isNotNull(), F.coalesce(first["reason"], F.lit(""))))
    return out.drop("_url", "_title", "_by_url", "_by_title")


def ingest_state(candidates: DataFrame, articles: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``state``: failed (blocked page), rejected, skipped (key exists or came twice), or success.

    ``candidates`` come from :func:`extract_articles` and :func:`flag_rejected`.
    """
    known = articles.select("article_key").distinct().withColumn("_known", F.lit(True))
    given = candidates if "_salt" in candidates.columns else candidates.withColumn("_salt", F.lit(0).cast("long"))
    order = ("url", F.xxhash64("html"), "_salt")
    parts = Window.partitionBy("article_key", "_salt").orderBy(*order)
    out = given.join(known, "article_key", "left").withColumn("_first", F.row_number().over(parts) == 1)
    # only the first rows of a key's parts meet in one group
    firsts = Window.partitionBy("article_key", F.when(F.col("_first"), -1).otherwise(F.col("_salt"))).orderBy(*order)
    out = out.withColumn("_first", F.col("_first") & (F.row_number().over(firsts) == 1))
    again = (F.col("_known").isNotNull() & F.lit(not force)) | ~F.col("_first")
    state = (
        F.when(F.col("blocked"), "failed")
        .when(F.col("rejected_reason").isNotNull(), "rejected")
        .when(again, "skipped")
        .otherwise("success")
    )
    error = F.when(F.col("blocked"), "blocked_wechat_page")
    return out.withColumn("state", state).withColumn("error_class", error).drop("_known", "_first", "_salt")


def ingest_job(pages: DataFrame, articles: DataFrame, rejected: DataFrame, today: str, force: bool = False) -> DataFrame:
    """Pages ``(url, html)`` through extraction and gate; rows of state success are the new articles, with status raw."""
    # rows of one key are parted by what they hold, so a task that runs again marks the same row; equal rows share a part
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in pages.columns]), F.lit(PARTS)))
    found = flag_rejected(E.extract_articles(salted, today), rejected, force)
    return ingest_state(found.withColumn("status", F.lit("raw")), articles, force)


def run_summary(results: DataFrame) -> DataFrame:
    """One row: total and how many of each state."""
    states = ("success", "skipped", "failed", "rejected")
    return results.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states]
    )


def failure_table(results: DataFrame, key: str) -> DataFrame:
    """(key, error_class, error) of the rows with an error."""
    error = F.col("error") if "error" in results.columns else F.col("error_class")
    return results.where(F.col("error_class").isNotNull()).select(F.col(key).alias("key"), "error_class", error.alias("error"))


def classify_error(error: Column) -> Column:
    e = F.lower(error)
    hit = lambda *words: E._any(e, words)
    return (
        F.when(hit("timed out", "timeout"), "timeout")
        .when(hit("json"), "json_parse_error")
        .when(hit("401", "403", "404", "500", "httpsconnectionpool", "request"), "api_error")
        .otherwise("other")
    )


def set_article_status(notes: DataFrame, updates: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, rejected, unknown): notes with the status of ``updates(article_key, status, reason)``.

    Of several updates of a key the last by a column ``place`` counts (without
    one, the greatest status by name); statuses that are not allowed are ignored.  Rejected notes are appended to ``rejected`` unless their
    address or title is there; a blank reason becomes the note's value.  ``unknown``
    holds updates of keys that are not notes.
    """
    placed = updates if "place" in updates.columns else updates.withColumn("place", F.lit(0))
    valid = placed.where(F.col("status").isin(*ALLOWED_STATUS))
    one = valid.groupBy("article_key").agg(F.max(F.struct("place", F.col("status").alias("new_status"), "reason")).alias("_u"))
    out = notes.join(one, "article_key", "left")
    gone = out.where("_u.new_status = 'rejected'").select(
        F.col("url").alias("source_url"),
        "title",
        F.coalesce(F.nullif(F.col("_u.reason"), F.lit("")), F.col("brainstorm_value"), F.lit("")).alias("reason"),
    )
    for key in ("source_url", "title"):
        known = rejected.where(F.coalesce(F.col(key), F.lit("")) != "").select(key)
        gone = gone.join(known, key, "left_anti")
    added = rejected.select("place", "source_url", "title", "reason").unionByName(
        gone.distinct().select(F.lit(LATER).alias("place"), "source_url", "title", "reason")
    )
    changed = out.withColumn("status", F.coalesce(F.col("_u.new_status"), F.col("status"))).drop("_u")
    return changed, added, updates.join(notes, "article_key", "left_anti")


def edit_status(articles: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, report): texts of ``articles(article_key, content)`` with the status of ``updates(article_key, status)`` in them.

    The first line that begins with a status gets the new value; a header
    without one gets a line at its end.  The report has a row an update:
    article_key, status and outcome, which is edited, inserted, ``no header``
    (the text stays as it is), ``not found`` or ``not allowed``.  Of several
    updates of a key the last by a column ``place`` counts, without one the
    greatest status by name; the others are ``superseded``.
    """
    placed = updates if "place" in updates.columns else updates.withColumn("place", F.lit(0))
    key = F.struct("place", "status")
    valid = placed.where(F.col("status").isin(*ALLOWED_STATUS))
    one = valid.groupBy("article_key").agg(F.max(key).alias("_u"))
    status = F.col("_u.status")
    # What a status line and a header are; a header ends at the next rule, wherever that stands.
    line, header = r"(?sm)\A(.*?^status:\s*)\S+", r"(?s)\A---\n(.*?)---\n"
    has_line, has_header = F.col("content").rlike(line), F.col("content").rlike(header)
    group = lambda pattern, k: F.regexp_extract("content", pattern, k)
    after = lambda pattern: F.substr("content", F.length(group(pattern, 0)) + 1)
    edited = F.concat(group(line, 1), status, after(line))
    body = F.regexp_replace(group(header, 1), r"\n+\z", "")
    inserted = F.concat(F.lit("---\n"), body, F.lit("\nstatus: "), status, F.lit("\n---\n"), after(header))
    joined = articles.join(one, "article_key", "left")
    outcome = F.when(has_line, "edited").when(has_header, "inserted").otherwise("no header")
    text = F.when(status.isNull(), F.col("content")).when(has_line, edited).when(has_header, inserted).otherwise(F.col("content"))
    out = joined.withColumn("content", text)
    said = joined.where(status.isNotNull()).select("article_key", F.col("_u").alias("_won"), outcome.alias("_o"))
    report = placed.join(said, "article_key", "left").join(articles.select("article_key", F.lit(True).alias("_known")), "article_key", "left")
    what = (
        F.when(~F.coalesce(F.col("status").isin(*ALLOWED_STATUS), F.lit(False)), "not allowed")
        .when(F.col("_known").isNull(), "not found")
        .when(F.col("_won") != key, "superseded")
        .otherwise(F.col("_o"))
    )
    return out.select(*articles.columns), report.select("article_key", "status", what.alias("outcome"))


def set_concept_status(concepts: DataFrame, updates: DataFrame) -> DataFrame:
    """Concepts with the status of ``updates(slug, status)``; deleted ones go, statuses that are not allowed change nothing."""
    one = updates.where(F.col("status").isin(*CONCEPT_STATUS)).groupBy("slug").agg(F.min("status").alias("_s"))
    out = concepts.join(one, "slug", "left").where("_s IS NULL OR _s <> 'deleted'")
    return out.withColumn("status", F.coalesce("_s", "status")).drop("_s")


def list_concepts(concepts: DataFrame, status: str | None = None) -> DataFrame:
    out = concepts.where(F.col("status") == status) if status else concepts
    return out.select("slug", "status", F.size("sources").alias("source_count"))


def review_queue(notes: DataFrame, stage: str = "raw") -> DataFrame:
    """(article_key, title, summary) of a stage; summaries over 150 characters are cut."""
    s = F.coalesce("summary", F.lit(""))
    short = F.when(F.length(s) > 150, F.concat(F.substring(s, 1, 150), F.lit("..."))).otherwise(s)
    return notes.where(F.col("status") == stage).select("article_key", "title", short.alias("summary"))


def numbered(rows: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with ``number`` from 1 in the order of ``key``, without sorting them in one task.

    Rows are sorted in ranges; a range's first number is the number of rows in
    the ranges before it, from one count a range.  ``keep`` writes a table and
    reads it again, so that both steps see the same ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parted = rows.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", at)
    parted = keep(parted)
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return parted.join(F.broadcast(base), "_part").select(*rows.columns, (F.col("_base") + F.col("_at") + 1).alias("number"))
