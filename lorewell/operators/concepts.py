"""State of concepts, lint rules over them, and what the query log says about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

# Sections whose bullets count for confidence, and those that lint reads.
CONFIDENCE_SECTIONS = ("key_idea_blocks", "variants", "failure_modes", "transfer_targets")
#: Hints that a concept keeps.
KEPT_HINTS = 12
LINT_SECTIONS = ("key_idea_blocks", "variants", "common_combinations", "transfer_targets", "failure_modes", "open_questions")


def confidence(concepts: DataFrame) -> DataFrame:
    """Share of bullets with a source; without bullets 0.5 with sources, else 0.1."""
    bullets = F.concat(*[F.col(c) for c in CONFIDENCE_SECTIONS if c in concepts.columns])
    anchored = F.size(F.filter(bullets, lambda b: F.size(T.bullet_sources(b)) > 0))
    value = F.when(F.size(bullets) == 0, F.when(F.size("sources") > 0, 0.5).otherwise(0.1)).otherwise(
        anchored / F.size(bullets)
    )
    return concepts.withColumn("confidence", value)


def duplicate_aliases(concepts: DataFrame) -> DataFrame:
    """(alias, slugs): aliases, trimmed and lower-cased, of more than one stable concept."""
    return (
        concepts.where("status = 'stable'")
        .select("slug", F.explode("aliases").alias("alias"))
        .withColumn("alias", F.lower(F.trim("alias")))
        .groupBy("alias")
        .agg(F.array_sort(F.collect_set("slug")).alias("slugs"))
        .where(F.size("slugs") > 1)
    )


def lint(concepts: DataFrame) -> DataFrame:
    """(severity, kind, slug, message) over stable concepts: claims, stubs and texts that need work."""
    stable = F.col("status") == "stable"
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")).rlike(r"^(_pending.*)?\z")
    no_sources = F.size("sources") == 0
    rules = [
        ("error", "unsupported_claims", stable & ~blank("synthesis") & no_sources, "synthesis without sources"),
        ("info", "seed_stub", stable & no_sources & (F.col("compile_version") == 0), "seed without sources"),
        ("warning", "orphan_concepts", stable & no_sources & (F.col("compile_version") > 0), "no sources"),
        ("warning", "schema_empty_synthesis", stable & (F.col("compile_version") > 0) & blank("synthesis"), "empty"),
    ]
    hits = F.filter(
        F.array(
            *[
                F.when(
                    cond, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), F.lit(m).alias("message"))
                )
                for s, k, cond, m in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )
    flagged = concepts.select("slug", F.explode(hits).alias("x")).select("x.severity", "x.kind", "slug", "x.message")
    empty = F.array().cast("array<string>")
    sections = [F.coalesce(F.col(c), empty) for c in LINT_SECTIONS if c in concepts.columns] or [empty]
    bullets = concepts.where(stable).select("slug", F.explode(F.concat(*sections)).alias("b"))
    loose = bullets.where(F.size(T.bullet_sources(F.col("b"))) == 0).select(
        F.lit("warning").alias("severity"), F.lit("unsupported_bullets").alias("kind"), "slug", F.col("b").alias("message")
    )
    return flagged.unionByName(loose)


def lint_summary(issues: DataFrame) -> DataFrame:
    """Issues of each severity, and whether none is an error."""
    return issues.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        (F.count_if(F.col("severity") == "error") == 0).alias("ok"),
    )


def apply_importance(log: DataFrame, state: DataFrame) -> DataFrame:
    """(slug, importance): each citing query adds 0.05, up to 1; concepts not known yet begin at 0."""
    cited = log.select(F.explode("cited_concepts").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))
    both = state.select("slug", "importance").join(cited, "slug", "full")
    total = F.coalesce("importance", F.lit(0.0)) + 0.05 * F.coalesce("n", F.lit(0))
    return both.select("slug", F.round(F.least(total, F.lit(1.0)), 4).alias("importance"))


def with_hints(state: DataFrame, hints: DataFrame, keep: int = KEPT_HINTS) -> DataFrame:
    """``state`` with ``hints(slug, place, hint)`` appended in order, those it has already left out; the last ``keep`` stay.

    Of each concept only its last ``keep`` different new hints are gathered, so
    one that every query cites makes no large group.
    """
    once = hints.groupBy("slug", "hint").agg(F.min("place").alias("place"))
    fresh = once.join(state.select("slug", F.explode("retrieval_hints").alias("hint")), ["slug", "hint"], "left_anti")
    w = Window.partitionBy("slug").orderBy(F.desc("place"), F.desc("hint"))
    last = fresh.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep)
    new = last.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("place", "hint"))).alias("_h"))
    all_ = F.concat(F.coalesce("retrieval_hints", F.array().cast("array<string>")), F.coalesce(F.col("_h.hint"), F.array().cast("array<string>")))
    kept = F.slice(all_, F.greatest(F.size(all_) - keep + 1, F.lit(1)), keep)
    out = state.join(new, "slug", "left")
    return out.withColumn("retrieval_hints", F.when(F.col("_h").isNull(), F.col("retrieval_hints")).otherwise(kept)).drop("_h")


def apply_feedback(log: DataFrame, state: DataFrame) -> DataFrame:
    """The state after ``log(log_id, query, cited_concepts)``: importance and hints; cited concepts without state come in as proposed.

    Rows that repeat a ``log_id`` count once.
    """
    rows = log.dropDuplicates(["log_id"])
    cited = rows.select("log_id", "query", F.explode(F.array_distinct("cited_concepts")).alias("slug"))
    known = state.select("slug")
    new = cited.select("slug").distinct().join(known, "slug", "left_anti").select(
        "slug", F.lit("proposed").alias("status"), F.lit(0.0).alias("importance"), F.array().cast("array<string>").alias("retrieval_hints")
    )
    filled = {"confidence": F.lit(0.0), "freshness": F.lit(0.0), "source_count": F.lit(0), "conflicts": F.lit(None)}
    for name, value in filled.items():
        if name in state.columns:
            new = new.withColumn(name, value.cast(state.schema[name].dataType))
    both = state.unionByName(new, allowMissingColumns=True)
    raised = apply_importance(rows.select(F.array_distinct("cited_concepts").alias("cited_concepts")), both.select("slug", "importance"))
    both = both.drop("importance").join(raised, "slug")
    return with_hints(both, cited.select("slug", F.col("log_id").alias("place"), T.query_slug(F.col("query")).alias("hint")))


def last_queries(log: DataFrame, n: int = 5) -> DataFrame:
    """(slug, query_id, place): each cited concept's last ``n`` queries, the newest first."""
    cited = log.select("query_id", F.explode("cited_concepts").alias("slug"))
    w = Window.partitionBy("slug").orderBy(F.desc("query_id"))
    return cited.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
