"""What the operators share: scratch tables, row keys and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where a local session names none (tests), a temporary folder is made and set
    as the session's checkpoint folder; on a cluster that is an error, since
    executors would not share it.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="lorewell-")
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/lorewell/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: later stages restart from the files when an executor
    is lost, and nothing upstream runs twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(few: DataFrame, column: str) -> DataFrame:
    """Rows that stand for much work each, such as files, dealt over as many tasks as a shuffle has.

    With a number given, adaptive execution does not merge the small partitions.
    """
    return few.repartition(int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def crc32_of_id(col) -> F.Column:
    return F.crc32(col.cast("string").cast("binary"))


#: Bytes that a table may have in memory, about, to be broadcast.
BROADCAST_BYTES = 32 << 20


def bytes_of(df: DataFrame) -> int:
    """Size of a table in memory, about: rows with their fixed parts, and what strings and arrays hold."""
    held = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            held = held + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif kind == "array":
            held = held + 8 * F.greatest(F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)), F.lit(0))
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return rows * (16 + 16 * len(df.columns)) + held


def if_small(saved_table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table that :func:`saved` wrote, marked for broadcasting if it is small by its bytes, else as it is."""
    return F.broadcast(saved_table) if bytes_of(saved_table) <= limit else saved_table


def row_keyed(df: DataFrame, id_col: str, text_col: str, key: str = "_key") -> tuple[DataFrame, bool]:
    """Add a unique long that orders rows as ``id_col`` does; and whether it is that id.

    Usually the ids are unique and serve themselves.  If some repeat or are
    null, rows are ordered by id (null first), then text, and numbered densely;
    equal rows get numbers of their own.  The test reads the id column alone.
    """
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    repeated = ids.groupBy("i").count().where("i IS NULL OR count > 1").limit(1).count()
    if not repeated:
        return df.withColumn(key, F.col(id_col).cast("long")), True
    spark = df.sparkSession
    order = [F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()]
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = saved(
        placed.withColumn("_part", F.spark_partition_id()).withColumn(
            "_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        ),
        "keyed",
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias(
            "_base"
        ),
    )
    placed = placed.join(F.broadcast(base), "_part")  # one row a partition
    return placed.withColumn(key, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base"), False


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every vertex of ``edges(a, b)``.

    Alternating large-star and small-star steps: each vertex is linked to the
    smallest neighbour it knows, which needs about log(n) joins-free rounds of
    grouping.  Every round is written to the shared folder.  Stars are built
    by windows' minima and not by collecting neighbours, so a vertex with very
    many links does not have to fit into memory, nor into one task.  Returns (id, component).
    """
    spark = edges.sparkSession
    e = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "edges",
    )

    def star(links: DataFrame, large: bool) -> DataFrame:
        if large:
            both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = links
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # written first: the join then reads both sides from shuffles of its own, and a hub's links are split
        least = saved(least, "least")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    before = None
    for _ in range(rounds):
        e = saved(star(star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
