"""Pages as a stream: each batch goes through extraction and the gate, and new articles are written by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lorewell.operators import ingest
from lorewell.sources import files


def stream_ingest(pages: DataFrame, rejected: DataFrame, out: str, checkpoint: str, today: str) -> StreamingQuery:
    """Write the new articles of ``pages(url, html)`` to ``out``, a folder a batch.

    A batch sees the keys of the other batches' folders only, and overwrites its
    own, so running it again gives the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = files.read_or_empty(spark, lambda: spark.read.parquet(out), "article_key string, batch int")
        known = known.where(f"batch <> {batch_id}").select("article_key")
        results = ingest.ingest_job(batch, known, rejected, today)
        results.where("state = 'success'").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
