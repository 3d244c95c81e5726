"""The registered queries of this subpackage, and DuckDB SQL where SQL can say the same.

Each query applies its operator to the whole table with production parameters
and takes its digest columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import (
    binary_packing,
    common,
    decontaminate,
    html_text,
    license_rules,
    line_quality,
    line_spread,
    merkle,
    near_dups,
    packing,
    suffix_dedup,
    token_files,
    tokens,
    toxicity,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"),
        common.scratch_path(spark, "token-files"),
        tokens.default_vocabulary("word_bpe_49k.json"),
        end_id=2,
    )
    return token_files.read_token_files(manifest)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_shared_lines(table(spark, sf_dir, "documents"), min_sites=12)
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan_licenses(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100, with_kept=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality.line_quality(table(spark, sf_dir, "documents"), min_left=0.7)
    return out.withColumn("shared_lines", F.array_join("shared_lines", ","))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), tokens.default_vocabulary("byte_bpe_50k.json"), end_id=2, size=1024
    )


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packing.pack_powers(
        table(spark, sf_dir, "documents"), tokens.default_vocabulary("byte_bpe_50k.json"), end_id=1, size=2048
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_html_text": op2_html_text,
    "op3_line_spread": op3_line_spread,
    "op4_license_rules": op4_license_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_line_quality": op7_line_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_best_fit": op9_best_fit,
    "op10_near_dups": op10_near_dups,
    "op11_whitening": op11_whitening,
    "op12_binary_packing": op12_binary_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_spread": line_spread.SQL.format(min_sites=12),
    "op7_line_quality": line_quality.SQL.format(max_docs=10, min_left=0.7),
    "op13_merkle_manifest": merkle.SQL,
}
