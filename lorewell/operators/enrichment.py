"""What a model is asked about an article, and what of its answer is kept."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import ingest

TEXTS = (
    "research_question", "core_hypothesis", "signal_framework", "application_scope", "holding_period", "summary",
    "entry_rule", "exit_rule", "rebalance_logic",
)
LISTS = ("constraints", "evidence_type", "contrast_points", "novelty_axes", "followup_questions", "risk_control")
CAPPED_LISTS = ("idea_blocks", "transfer_targets", "combination_hooks", "failure_modes")

# What enumerated fields may hold.
ENUMS = {
    "reusability": ("idea_only", "adaptable", "directly_implementable"),
    "source_claim_strength": ("weak", "moderate", "strong"),
    "brainstorm_value": ("low", "medium", "high"),
}
CONTENT_TYPES = ("methodology", "strategy", "allocation", "risk_control", "market_review")
TAXONOMIES = {
    "market": (
        "a_share", "hk_equity", "us_equity", "commodity_futures", "index_futures", "bond", "fx", "crypto", "multi_asset", "general",
    ),
    "asset_type": (
        "stock", "etf", "future", "option", "bond", "currency", "crypto_asset", "index", "sector_basket", "multi_asset",
        "general_time_series",
    ),
    "strategy_type": (
        "trend_following", "mean_reversion", "cross_sectional", "time_series_forecast", "factor_model", "allocation_rotation",
        "event_driven", "stat_arb", "pair_trading", "options_volatility", "macro_regime", "ml_prediction", "risk_model",
        "risk_control", "volatility_targeting", "drawdown_control", "position_sizing", "regime_filter",
        "execution_microstructure", "seasonal_calendar", "momentum", "carry", "breakout", "engineering_system",
    ),
}
PLACEHOLDER = "待补充。"
SECTIONS = {
    "Summary": "summary", "Research Question": "research_question", "Core Hypothesis": "core_hypothesis",
    "Application Scope": "application_scope", "Constraints": "constraints", "Idea Blocks": "idea_blocks",
    "Combination Hooks": "combination_hooks", "Transfer Targets": "transfer_targets", "Contrast Points": "contrast_points",
    "Failure Modes": "failure_modes", "Follow-up Questions": "followup_questions",
}
STRATEGY_SECTIONS = {
    "Signal / Feature Definition": "signal_framework", "Entry Rule": "entry_rule", "Exit Rule": "exit_rule",
    "Rebalance / Holding Logic": "rebalance_logic", "Risk Control": "risk_control", "Backtest Metrics": "backtest_metrics",
}
OTHER_SECTIONS = {"Signal Framework / Decision Framework": "signal_framework"}


def select_for_enrichment(notes: DataFrame, status: str = "raw", force: bool = False, limit: int | None = None) -> DataFrame:
    """Notes of a status that are not enriched yet; ``limit`` counts keys by name before either is looked at."""
    out = notes.orderBy("article_key").limit(limit) if limit else notes
    out = out.where(F.col("status") == status)
    return out if force else out.where(~F.coalesce("llm_enriched", F.lit(False)))


def enrichment_prompts(notes: DataFrame, chars: int = 8000, blocks: int = 3, block_chars: int = 800) -> DataFrame:
    """(article_key, prompt): fields by name, the main content and the first code blocks, each cut to its share."""
    fields = ("title", "content_type", "summary", "research_question", "core_hypothesis", "signal_framework")
    named = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f), F.lit(""))) for f in fields if f in notes.columns]
    empty = F.array().cast("array<struct<language:string,content:string>>")
    code = F.coalesce(F.col("code_blocks"), empty) if "code_blocks" in notes.columns else empty
    shown = F.transform(
        F.slice(code, 1, blocks),
        lambda b: F.concat(
            F.lit("["), F.coalesce(b["language"], F.lit("text")), F.lit("]\n"), F.substring(F.coalesce(b["content"], F.lit("")), 1, block_chars)
        ),
    )
    main = F.substring(F.coalesce("main_content", F.lit("")), 1, chars)
    prompt = F.concat_ws("\n", *named, F.lit("\nmain_content:"), main, F.lit("\ncode_blocks:"), F.array_join(shown, "\n\n"))
    return notes.select("article_key", prompt.alias("prompt"))


def _text(v: Column, name: str) -> Column:
    return T.strip(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def _list(v: Column, name: str) -> Column:
    """The items of a list, or the one text; blank ones go."""
    items = F.try_variant_get(v, f"$.{name}", "array<string>")
    one = F.array(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))
    return F.filter(F.transform(F.coalesce(items, one), T.strip), lambda x: x != "")


def _known(items: Column, allowed: tuple) -> Column:
    return F.filter(items, lambda x: x.isin(*allowed))


def parse_enrichment(answers: DataFrame) -> DataFrame:
    """Typed fields of ``answers(article_key, content_type, raw)`` and ``error``, which is null if ``raw`` is a JSON object.

    A fence around the object is removed.  Unknown values of enumerations become
    empty, unknown terms of a taxonomy go, four lists are cut to five items, and
    confidence lies within 0 and 1.  Fields of trade stay for strategies alone, the
    rebalancing logic also for allocations.
    """
    fenced = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)```json\s*(\{.*\})\s*```", 1)
    v = F.col("_v")
    kind = F.when(F.col("content_type").isin(*CONTENT_TYPES), F.col("content_type")).otherwise("methodology")
    strategy = kind == "strategy"
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    number = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))
    fields = {c: _text(v, c) for c in TEXTS} | {c: _list(v, c) for c in LISTS}
    fields |= {c: F.slice(_list(v, c), 1, 5) for c in CAPPED_LISTS}
    for c, allowed in ENUMS.items():
        fields[c] = F.when(_text(v, c).isin(*allowed), _text(v, c)).otherwise("")
    for c, allowed in TAXONOMIES.items():
        fields[c] = _known(_list(v, c), allowed)
    metrics = F.try_variant_get(v, "$.backtest_metrics", "variant")
    none = F.array().cast("array<string>")
    fields |= {
        "confidence": F.when(F.isnan(number), 0.0).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))),
        "entry_rule": F.when(strategy, fields["entry_rule"]).otherwise(""),
        "exit_rule": F.when(strategy, fields["exit_rule"]).otherwise(""),
        "rebalance_logic": F.when(kind.isin("strategy", "allocation"), fields["rebalance_logic"]).otherwise(""),
        "risk_control": F.when(strategy, fields["risk_control"]).otherwise(none),
        "backtest_metrics": F.when(
            strategy & F.coalesce(F.schema_of_variant(metrics).startswith("OBJECT"), F.lit(False)), F.to_json(metrics)
        ).otherwise("{}"),
        "error": F.when(~is_object, "json_parse_error"),
    }
    parsed = answers.withColumn("_v", F.try_parse_json(F.when(fenced != "", fenced).otherwise(F.col("raw"))))
    return parsed.select("article_key", kind.alias("content_type"), *[c.alias(n) for n, c in fields.items()], "raw")


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def replace_section(body: Column, heading: str, content: Column) -> Column:
    """The body with the text under ``## heading`` replaced; blank content becomes a placeholder."""
    filled = F.when(T.strip(content) == "", PLACEHOLDER).otherwise(T.strip(content))
    quoted = F.regexp_replace(filled, r"([\\$])", r"\\$1")
    pattern = F.lit(rf"(?s)(## \Q{heading}\E\n\n).*?(?=\n## |\z)")
    return F.regexp_replace(body, pattern, F.concat(F.lit("$1"), quoted, F.lit("\n")))


def merge_enrichment(notes: DataFrame, enriched: DataFrame, model: str, now: str) -> DataFrame:
    """Notes with the fields and body sections of good answers; others keep theirs and get the error.

    Only columns that the notes have are overwritten.  Adds ``llm_enriched``,
    ``llm_model``, ``llm_enriched_at``, ``llm_raw_response`` and ``llm_error``.
    """
    e = enriched.select(F.col("article_key"), F.struct(*[c for c in enriched.columns if c != "article_key"]).alias("_e"))
    out = notes.drop("llm_enriched", "llm_model", "llm_enriched_at", "llm_raw_response", "llm_error").join(e, "article_key", "left")
    asked, good = F.col("_e").isNotNull(), F.col("_e").isNotNull() & F.col("_e.error").isNull()
    names = [*TEXTS, *LISTS, *CAPPED_LISTS, *ENUMS, *TAXONOMIES, "confidence", "backtest_metrics"]
    new = {n: F.when(good, F.col(f"_e.{n}")).otherwise(F.col(n)) for n in names if n in notes.columns}
    if "body" in notes.columns:
        lists = {*LISTS, *CAPPED_LISTS}

        def rewritten(body: Column, sections: dict[str, str]) -> Column:
            for heading, field in sections.items():
                value = F.col(f"_e.{field}")
                value = _bullets(value) if field in lists else F.when(value == "{}", "").otherwise(value)
                body = replace_section(body, heading, value)
            return body

        both = rewritten(F.col("body"), SECTIONS)
        by_kind = F.when(F.col("_e.content_type") == "strategy", rewritten(both, STRATEGY_SECTIONS))
        new["body"] = F.when(good, by_kind.otherwise(rewritten(both, OTHER_SECTIONS))).otherwise(F.col("body"))
    new |= {
        "llm_enriched": good,
        "llm_model": F.when(asked, F.lit(model)),
        "llm_enriched_at": F.when(asked, F.lit(now)),
        "llm_raw_response": F.when(good, F.col("_e.raw")),
        "llm_error": F.coalesce(F.col("_e.error"), F.lit("")),
    }
    return out.withColumns(new).drop("_e")


class Enriched(NamedTuple):
    """Notes after an enrichment, failures by article, and one row of counts."""

    notes: DataFrame
    failures: DataFrame
    summary: DataFrame


def enrich_job(
    notes: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    keep: Callable[[DataFrame], DataFrame],
    model: str,
    now: str,
    status: str = "raw",
    force: bool = False,
    limit: int | None = None,
) -> Enriched:
    """Notes of a status that are not enriched yet are put to a model, and what it answers is merged into them.

    ``ask(prompts)`` gives ``(article_key, raw, error)``, as ``call_model`` does;
    ``keep`` writes a table and reads it again, so that no article is asked about
    twice.  Notes that were not asked about stay as they are.
    """
    chosen = select_for_enrichment(notes, status, force, limit)
    asked = keep(ask(enrichment_prompts(chosen)))
    kinds = notes.select("article_key", "content_type")
    parsed = parse_enrichment(asked.join(kinds, "article_key").select("article_key", "content_type", "raw"))
    called = asked.select("article_key", F.col("error").alias("_call"))
    parsed = keep(parsed.join(called, "article_key").withColumn("error", F.coalesce("_call", "error")).drop("_call"))
    mine = notes.join(parsed.select("article_key"), "article_key", "left_semi")
    rest = notes.join(parsed.select("article_key"), "article_key", "left_anti")
    merged = merge_enrichment(mine, parsed, model, now).unionByName(rest, allowMissingColumns=True)
    failed = parsed.where("error IS NOT NULL")
    failures = failed.select(F.col("article_key").alias("key"), ingest.classify_error(F.col("error")).alias("error_class"), "error")
    total = notes.agg(F.count("*").alias("total"))
    done = parsed.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    counts = total.crossJoin(done)  # one row each
    return Enriched(merged, failures, counts.withColumn("skipped", F.col("total") - F.col("success") - F.col("failed")))
