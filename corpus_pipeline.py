"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common, decontaminate, line_spread, near_dups, packing, tokens, toxicity

def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` lacks."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _without(docs: DataFrame, find, name: str) -> DataFrame:
    """``docs`` without the rows whose number ``find(numbered, number)`` gives; ids can repeat or be null, row numbers cannot."""
    key = _free(docs, "_row")
    numbered, _ = common.row_keyed(docs, "doc_id", "text", key=key)
    gone = common.if_small(common.saved(find(numbered, key).select(key).distinct(), name))
    return numbered.join(gone, key, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more.

    Null and empty texts score as texts without known words and stay; equal rows
    go or stay together; without toxic labels, or without documents, nothing goes.
    Columns of any name stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = ~F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    model = toxicity.train(docs.where(rest), labels.where(rest))
    score = _free(docs, "_toxicity")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < 0.7).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that many sites share; n_chars, where there is one, is counted anew.

    No row goes: a text whose lines all go is empty, a null text stays null.
    Columns named n_lines and n_removed, which the operator adds, are kept as they came.
    """
    kept = {c: _free(docs, f"_{c}") for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_spread.remove_shared_lines(docs.withColumnsRenamed(kept)).drop("n_lines", "n_removed")
    out = out.withColumnsRenamed({v: k for k, v in kept.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    The first row in id (null first), text order stays.  Texts without words,
    null ones too, are in no group and stay; of equal rows with words one stays.
    """

    def find(numbered: DataFrame, key: str) -> DataFrame:
        return near_dups.near_duplicates(numbered, id_col=key, words=5, percent=80).where("NOT kept")

    return _without(docs, find, "dropped")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, edited or not.

    Each row is judged by its own text; texts without words stay, and all stay
    if the benchmark is empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda numbered, key: decontaminate.contaminated(numbered, items, id_col=key), "contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 1024; a small cache, since workers hold memory of earlier stages.

    Every row is packed, a null or empty text as its end id alone; repeated ids
    are documents of their own.
    """
    vocabulary = tokens.default_vocabulary("byte_bpe_50k.json")
    return packing.pack_documents(docs, vocabulary, end_id=2, size=1024, cache=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't train the classifier or run the tokenizer; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's documents are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.saved(docs, name.replace(" ", "-"))
    return docs
