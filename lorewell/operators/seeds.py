"""Concepts that a new knowledge base starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Slug, title, aliases, content types, definition.
SEEDS = (
    ("factor-models", "Factor Models", ["因子模型", "多因子"], ["methodology"],
     "Multi-factor frameworks describing cross-sectional return drivers."),
    ("factor-timing", "Factor Timing", ["因子择时"], ["methodology"],
     "Methods that vary factor exposure over time based on signals or regime."),
    ("regime-detection", "Regime Detection", ["风格切换", "状态识别"], ["methodology"],
     "Identification of market states that change which strategies work."),
    ("momentum-strategies", "Momentum Strategies", ["动量策略", "momentum"], ["strategy"],
     "Trading rules that buy past winners or trend assets."),
    ("etf-rotation", "ETF Rotation", ["etf轮动", "行业轮动"], ["strategy", "allocation"],
     "Periodic rebalancing across ETFs/sectors based on a ranking signal."),
    ("risk-parity", "Risk Parity", ["风险平价"], ["allocation", "risk_control"],
     "Portfolio construction that allocates by risk contribution rather than capital weight."),
    ("volatility-targeting", "Volatility Targeting", ["波动率择时", "风险预算"], ["risk_control"],
     "Position sizing based on rolling realized or implied volatility."),
)
SEED_SCHEMA = "slug string, title string, aliases array<string>, content_types array<string>, definition string"


def seed_concepts(spark: SparkSession, today: str) -> DataFrame:
    """The seeds as stable concepts of version 0 without sources."""
    return spark.createDataFrame(list(SEEDS), SEED_SCHEMA).withColumns(
        {
            "status": F.lit("stable"),
            "sources": F.array().cast("array<string>"),
            "last_compiled": F.lit(today),
            "compile_version": F.lit(0),
            "synthesis": F.lit("_pending: no sources yet_"),
        }
    )


def bootstrap(concepts: DataFrame, seeds: DataFrame) -> DataFrame:
    """The concepts and those seeds whose slug is new; running it again changes nothing."""
    missing = seeds.join(concepts.select("slug"), "slug", "left_anti")
    return concepts.unionByName(missing, allowMissingColumns=True)
