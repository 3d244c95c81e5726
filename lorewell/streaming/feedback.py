"""Query feedback as a stream: each log row raises the importance of the concepts it cites, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.operators import concepts
from lorewell.sources import scratch
from lorewell.sources.store import Change, Store

LOG = "log_id long, query string, cited_concepts array<string>"
#: The table of a feedback store, and its key.
STORED = {"state": "slug"}


def begin(store: Store, state: DataFrame) -> None:
    """Put the state of concepts as it is before the stream into a new store."""
    store.commit({"state": Change(state)})


def apply_batch(store: Store, rows: DataFrame, tag: str) -> None:
    """Merge ``rows(log_id, query, cited_concepts)`` into the stored state; a batch whose tag was committed is passed over.

    Only the buckets of concepts that the rows cite are read and written, so a
    batch costs what it brings, whatever came before it.
    """
    source, _, number = tag.rpartition("#")
    last_source, _, last = store.tag().rpartition("#")
    if last and source == last_source and int(number) <= int(last):
        return
    rows = scratch.kept(rows.select("log_id", "query", "cited_concepts"))
    cited = scratch.kept(rows.select(F.explode("cited_concepts").alias("slug")).distinct())
    buckets = [r.b for r in cited.select(store.bucket(F.col("slug")).alias("b")).distinct().collect()]
    known = store.read("state", only=buckets)
    if known is None:
        raise ValueError("the store has no state to begin with")
    after = concepts.apply_feedback(rows, known.join(cited, "slug", "left_semi"))
    store.commit({"state": Change(after.select(*known.columns))}, tag=tag)


def stream_feedback(
    log: DataFrame, store_root: str, checkpoint: str, time_col: str | None = None, late: str = "7 days"
) -> StreamingQuery:
    """Merge the stream ``log(log_id, query, cited_concepts)`` into the state in the store at ``store_root``.

    Log ids that came before are kept in the stream's own state, so a row that
    comes again, in any later batch, counts once; with ``time_col`` an id is
    forgotten once the watermark has passed it by ``late``, which bounds that
    state.  A batch that runs again after a failure finds its tag in the store.
    Rows of a batch are taken in the order of their ids, batches as they come:
    a late row is taken when it comes.
    """
    if time_col:
        once = log.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["log_id"])
    else:
        once = log.dropDuplicates(["log_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(Store(batch.sparkSession, store_root, STORED), batch, f"{checkpoint}#{batch_id}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
