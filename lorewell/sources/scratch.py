"""Tables that a job writes and reads again, so that what made them does not run twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="lorewell-")
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The table after it was written to the shared folder; an executor that is lost costs no more than reading it again."""
    path = f"{folder(df.sparkSession)}/lorewell-jobs/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
