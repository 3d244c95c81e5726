"""Readers and writers of the knowledge base's files and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.sources import folders, scratch

#: Version that state and manifest carry; other versions read as empty.
STATE_VERSION = "1"
SIDECAR = (
    "source_url string, source_type string, ingested_at string, llm_enriched boolean, llm_error string, "
    "code_blocks array<struct<language: string, source: string, content: string>>, image_urls array<string>"
)
SOURCE_STATE = "path string, content_hash string, last_seen string, feeds_concepts array<string>"
CONCEPT_STATE = (
    "slug string, status string, confidence double, importance double, freshness double, last_compiled string, "
    "compile_version int, source_count int, conflicts array<string>, retrieval_hints array<string>"
)
MANIFEST = "article_key string, hash string, block_count int, source_dir string"


def read_or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What ``read`` gives, or an empty table if its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _whole_files(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """(article_key, ``name``) of files one folder deep; the key is the folder."""

    def read():
        found = spark.read.format("binaryFile").load(pattern)
        return found.select(F.element_at(F.split("path", "/"), -2).alias("article_key"), F.col("content").cast("string").alias(name))

    return read_or_empty(spark, read, f"article_key string, {name} string")


def _sidecar(raw: F.Column) -> F.Column:
    return F.from_json(raw, SIDECAR).alias("sidecar")


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """(article_key, content, hash) of every ``raw/*/article.md``; a missing root gives no rows.

    A path that only Spark can open is read as binary files, which leave out files of no bytes.
    """
    if folders.opened(root):
        found = folders.read_folders(spark, root).select("article_key", "content")
    else:
        found = _whole_files(spark, f"{root}/raw/*/article.md", "content")
    return found.withColumn("hash", F.sha2("content", 256))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(article_key, sidecar) of every ``raw/*/source.json``; text that is no JSON object gives a null sidecar."""
    raw = _whole_files(spark, f"{root}/raw/*/source.json", "raw")
    return raw.select("article_key", _sidecar(F.col("raw")))


def read_articles_with_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Articles and their sidecar's fields by one scan of the folders; the fields are null without a readable sidecar."""
    if not folders.opened(root):
        return with_sidecars(read_articles(spark, root), read_sidecars(spark, root))
    found = folders.read_folders(spark, root)
    return found.select("article_key", "content", F.sha2("content", 256).alias("hash"), _sidecar(F.col("sidecar"))).select(
        "article_key", "content", "hash", "sidecar.*"
    )


def with_sidecars(articles: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Articles with their sidecar's fields; all null where there is none."""
    return articles.join(sidecars, "article_key", "left").select(*articles.columns, "sidecar.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a Parquet table."""
    return read_or_empty(spark, lambda: spark.read.parquet(path), "url string, html string")


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line) of text files, for :func:`lorewell.operators.ingest.clean_urls`; places follow file and position."""

    def read():
        lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), "value")
        split = lines.select("f", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
        return split.select(F.struct("f", "n").alias("place"), "line")

    return read_or_empty(spark, read, "place struct<f: string, n: int>, line string")


def state_from_json(texts: DataFrame, version: str = STATE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(source_state, concept_state) of ``texts(value)``, state files as JSON; another version or bad text gives no rows.

    Entries that are no objects go; missing fields get their defaults.
    """
    v = texts.select(F.try_parse_json("value").alias("v"))
    v = v.where(F.try_variant_get("v", "$.schema_version", "string") == version)

    def entries(name: str, key: str) -> DataFrame:
        pairs = F.explode(F.try_variant_get("v", f"$.{name}", "map<string, variant>")).alias(key, "e")
        return v.select(pairs).where(F.schema_of_variant("e").startswith("OBJECT"))

    def field(name: str, kind: str, default) -> F.Column:
        value = F.try_variant_get("e", f"$.{name}", kind)
        if kind == "array<string>":
            filled = F.filter(value, lambda x: x.isNotNull() & (x != ""))
            return F.coalesce(filled, F.array().cast(kind)).alias(name)
        return F.coalesce(value, F.lit(default).cast(kind)).alias(name)

    def typed(schema: str, defaults: dict) -> list:
        zero = {"string": "", "double": 0.0, "int": 0, "array<string>": None}
        names = [c.strip().split(" ") for c in schema.split(",")]
        return [F.col(names[0][0]), *[field(n, k, defaults.get(n, zero[k])) for n, k in names[1:]]]

    sources = entries("sources", "path").select(*typed(SOURCE_STATE, {}))
    return sources, entries("concepts", "slug").select(*typed(CONCEPT_STATE, {"status": "stable"}))


def write_state(state: DataFrame, path: str, version: str = STATE_VERSION) -> None:
    """Write a state or manifest table with its version."""
    state.withColumn("schema_version", F.lit(version)).write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str, schema: str, version: str = STATE_VERSION) -> DataFrame:
    """A table that :func:`write_state` wrote; a missing one or another version gives no rows."""
    full = f"{schema}, schema_version string"
    rows = read_or_empty(spark, lambda: spark.read.schema(full).parquet(path), full)
    return rows.where(F.col("schema_version") == version).drop("schema_version")


def write_articles(articles: DataFrame, path: str) -> None:
    """Add new articles to the table at ``path``, in folders by status and content type, so that readers skip what they don't ask for.

    Articles that are there stay.  A key that is there already is not written
    again, so a run that is repeated adds nothing; of rows that share a key one is written.
    """
    spark = articles.sparkSession
    known = read_or_empty(spark, lambda: spark.read.parquet(path).select("article_key"), "article_key string")
    fresh = articles.dropDuplicates(["article_key"]).join(known, "article_key", "left_anti")
    fresh = scratch.kept(fresh)  # the table can't be read while it is written
    fresh.write.mode("append").partitionBy("status", "content_type").parquet(path)


def replace_articles(articles: DataFrame, path: str) -> None:
    """Write articles anew; of the table at ``path`` only the folders that they fall into are replaced."""
    fresh = scratch.kept(articles)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "content_type").parquet(path)


def write_failures(failures: DataFrame, path: str) -> None:
    """(key, error_class, error) as tab-separated text."""
    failures.select("key", "error_class", "error").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_report(rows: DataFrame, path: str) -> None:
    """Lint issues or suggestions as JSON lines."""
    rows.write.mode("overwrite").json(path)


def append_query_log(log: DataFrame, path: str) -> None:
    """Rows of answered queries, in folders by their date; a row that is in its date's folder already is not written again."""
    spark = log.sparkSession
    days = [r.date for r in log.select("date").distinct().collect()]  # of one run
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    known = read_or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema).where(F.col("date").isin(days))
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in log.columns])
    fresh = log.dropDuplicates().withColumn("_row", row).join(known.select(row.alias("_row")), "_row", "left_anti").drop("_row")
    scratch.kept(fresh).write.mode("append").partitionBy("date").parquet(path)
