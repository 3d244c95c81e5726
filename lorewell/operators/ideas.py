"""Scores of ideas: how new they are, whether they name what they came from, and both with a judge's view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import hundredths, unfenced

# From which similarity on an idea is known, and how many neighbours count.
NOVEL_BELOW = 0.75
NEIGHBOURS = 5
# Weights of traceability, coherence and actionability.
WEIGHTS = {"traceability": 0.30, "coherence": 0.35, "actionability": 0.35}


def novelty(ideas: DataFrame, matches: DataFrame) -> DataFrame:
    """(idea_id, novel, best_id, best_score) from ``matches(idea_id, id, score)``.

    An idea without a match, or whose best is below the limit, is novel and
    then names no match.  Of equal scores the smallest id counts.
    """
    w = Window.partitionBy("idea_id").orderBy(F.desc("score"), "id")
    top = matches.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    known = top.where(F.col("score") >= NOVEL_BELOW).select("idea_id", "id", "score")
    return ideas.select("idea_id").join(known, "idea_id", "left").select(
        "idea_id",
        F.col("score").isNull().alias("novel"),
        F.col("id").alias("best_id"),
        F.round("score", 3).alias("best_score"),
    )


def closest(ideas: DataFrame, matches: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """(idea_id, matches): the ``n`` closest of ``matches(idea_id, id, score)``, best first, scores to three places; empty without any."""
    w = Window.partitionBy("idea_id").orderBy(F.desc("score"), "id")
    top = matches.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_k", "id", F.round("score", 3).alias("score"))))  # n at most
    listed = top.groupBy("idea_id").agg(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score"))).alias("matches"))
    out = ideas.select("idea_id").join(listed, "idea_id", "left")
    return out.withColumn("matches", F.coalesce("matches", F.filter(F.array(F.struct(F.lit(None).cast(matches.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score"))), lambda x: F.lit(False))))


def traceability(ideas: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(idea_id, traceability) from ``ideas(idea_id, query_id, inspired_by, core_logic)`` and retrieved titles.

    0.4 if the idea says what inspired it, 0.4 if a title stands there, 0.2 if
    two or more titles stand in its logic.  Blank titles don't count.
    """
    titles = retrieved.where(F.trim("title") != "").select("query_id", "title").distinct()
    by, logic = F.coalesce("inspired_by", F.lit("")), F.coalesce("core_logic", F.lit(""))
    pairs = ideas.select("idea_id", "query_id", by.alias("by"), logic.alias("logic")).join(titles, "query_id", "left")
    found = lambda c: F.coalesce(F.col(c).contains(F.col("title")), F.lit(False)).cast("int")
    return (
        pairs.groupBy("idea_id")
        .agg(F.max(F.trim("by") != "").alias("said"), F.max(found("by")).alias("named"), F.sum(found("logic")).alias("n"))
        .select(
            "idea_id",
            F.round(
                F.when(F.col("said"), 0.4).otherwise(0.0)
                + F.when(F.col("named") == 1, 0.4).otherwise(0.0)
                + F.when(F.col("n") >= 2, 0.2).otherwise(0.0),
                1,
            ).alias("traceability"),
        )
    )


def composite(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """(idea_id, quality): the weighted sum to two places; a judge's missing values are 0.5, others are held between 0 and 1."""
    # greatest and least skip nulls, so these are asked for first
    held = lambda c: F.when(F.col(c).isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    both = scores.join(judged.select("idea_id", "coherence", "actionability"), "idea_id", "left")
    parts = [
        WEIGHTS["traceability"] * F.col("traceability"),
        WEIGHTS["coherence"] * held("coherence"),
        WEIGHTS["actionability"] * held("actionability"),
    ]
    return both.select("idea_id", hundredths(parts[0] + parts[1] + parts[2]).alias("quality"))


#: What a judge's answer counts as where it can't be used.
UNJUDGED = 0.5


def parse_judged(answers: DataFrame, ideas: DataFrame) -> DataFrame:
    """(idea_id, coherence, actionability, judged) of ``ideas(output_id, place, idea_id)`` from ``answers(output_id, raw)``.

    An answer is a JSON list, fenced or not, with an object for each of the
    output's ideas, in their order.  A missing value is 0.5, others are held
    between 0 and 1.  An answer that is no such list, has another length or a
    value that is no number gives 0.5 for all its ideas, and so does a missing
    answer; ``judged`` is then false.
    """
    names = ("coherence", "actionability")
    counts = ideas.groupBy("output_id").agg(F.count("*").alias("_n"))
    list_ = F.try_variant_get(F.try_parse_json(unfenced(F.col("raw"))), "$", "array<variant>")
    one = answers.groupBy("output_id").agg(F.max("raw").alias("raw"))

    def value(entry, name: str):
        given = F.try_variant_get(entry, f"$.{name}", "variant")
        number = F.try_variant_get(entry, f"$.{name}", "double")
        return F.when(given.isNull(), UNJUDGED).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)) + 0 * number)

    def fine(entry):
        values = [value(entry, n) for n in names]
        return F.schema_of_variant(entry).startswith("OBJECT") & values[0].isNotNull() & values[1].isNotNull()

    read = one.join(counts, "output_id").withColumn("_l", list_)
    whole = (F.size("_l") == F.col("_n")) & F.forall("_l", lambda e: F.coalesce(fine(e), F.lit(False)))
    good = read.where(F.coalesce(whole, F.lit(False))).select("output_id", F.posexplode("_l").alias("place", "_e"))
    good = good.select("output_id", "place", *[value(F.col("_e"), n).alias(n) for n in names])
    out = ideas.select("output_id", "place", "idea_id").join(good, ["output_id", "place"], "left")
    return out.select(
        "idea_id", *[F.coalesce(n, F.lit(UNJUDGED)).alias(n) for n in names], F.col("coherence").isNotNull().alias("judged")
    )
