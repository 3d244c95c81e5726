"""Sequences of power-of-two lengths, none of which crosses a document.

A document of n tokens is cut into as many full sequences as it holds and then
into one piece for each set bit of what is left, longest first, so every piece
has a length that is a power of two, none is padded and none has tokens of two
documents.  Pieces of one length form a bucket; buckets are laid out one after
another over range partitions, and a sequence's number is its place there, by
prefix sums.  A trainer draws batches from one bucket at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm import common, tokens


def cuts(n_tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of one token or more, in order."""
    full, left = n_tokens // size, n_tokens % size
    places = np.arange(size.bit_length() - 2, -1, -1)
    bits = (left[:, None] >> places) & 1
    counts = full + bits.sum(1)
    doc = np.repeat(np.arange(len(n_tokens)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.full(len(doc), size, np.int64)
    length[piece >= full[doc]] = (bits << places)[bits == 1]
    before = np.cumsum(length) - length
    first = (np.cumsum(n_tokens) - n_tokens)[doc]
    return doc, before - first, length


_PIECE = "_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, end_id: int, size: int, with_ids: bool, cache: int):
    def run(batches):
        for batch in batches:
            for a, b, ids, offsets in tokens.encoded(batch["_t"], path, end_id, cache):
                n_tokens = np.diff(offsets)
                doc, start, length = cuts(n_tokens, size)
                raw = memoryview(ids.astype("<u4")).cast("B")
                at = 4 * (offsets[doc] + start)
                parts = [raw[x:y] for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
                rows = pa.array(a + doc)
                cols = [
                    batch["_key"].take(rows),
                    batch["_id"].take(rows),
                    pa.array(start),
                    pa.array(length),
                    pa.array(list(map(zlib.crc32, parts)), pa.int64()),
                    pa.array(n_tokens[doc]),
                ]
                names = ["_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pack_powers(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    size: int = 2048,
    with_ids: bool = False,
    cache: int = tokens.CACHE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every token of every document in sequences of power-of-two length, ``size`` (one itself) at most.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    (buckets of equal length one after another, shortest first, in each the
    order of id and start), offset (0, since a sequence is one piece) and the
    ids as little-endian unsigned 32-bit integers if asked for.  Texts are
    encoded whole; null and empty ones have the end id alone, one sequence of
    length 1.  Rows that repeat an id or have none are documents of their own.
    An empty table gives an empty result; other columns are ignored.
    """
    if size < 1 or size & (size - 1):
        raise ValueError(f"size {size} is not a power of two")
    spark = docs.sparkSession
    keyed, _ = common.row_keyed(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")), "_id", "_t"
    )
    schema = _PIECE + ", ids binary" * with_ids
    pieces = common.saved(
        keyed.select("_key", "_id", "_t").mapInArrow(_cut(vocabulary, end_id, size, with_ids, cache), schema), "binary-pieces"
    )
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["length", "_key", "start"]
    placed = (
        pieces.repartitionByRange(n, *by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    placed = common.saved(placed, "binary-placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = base.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = placed.join(F.broadcast(base), "_part").withColumn("sequence_id", F.col("_base") + F.col("_at"))
    out = out.withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*names, *["ids"] * with_ids)


def write_buckets(packed: DataFrame, folder: str) -> DataFrame:
    """Write the sequences of ``pack_powers(..., with_ids=True)`` as Parquet, a folder for each length.

    A bucket is spread over as many files as tasks hold it; returns per length
    the sequences, tokens and the first and last sequence_id.
    """
    packed.select("length", "sequence_id", "doc_id", "start", "ids").write.partitionBy("length").parquet(folder)
    written = packed.sparkSession.read.parquet(folder)
    return written.groupBy(F.col("length").cast("long").alias("length")).agg(
        F.count("*").alias("sequences"),
        (F.count("*") * F.first(F.col("length").cast("long"))).alias("tokens"),
        F.min("sequence_id").alias("first_sequence"),
        F.max("sequence_id").alias("last_sequence"),
    )


def read_bucket(spark, folder: str, length: int) -> DataFrame:
    """The sequences of one length: sequence_id, doc_id, start and ids as an array of integers."""
    of_one = spark.read.parquet(folder).where(F.col("length") == length)

    def ids(batches):
        for batch in batches:
            column = batch["ids"]
            flat = np.frombuffer(b"".join(column.to_pylist()), "<i4")
            offsets = np.arange(len(column) + 1, dtype=np.int32) * length
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch["sequence_id"], batch["doc_id"], batch["start"], lists], ["sequence_id", "doc_id", "start", "ids"]
            )

    return of_one.select("sequence_id", "doc_id", "start", "ids").mapInArrow(
        ids, "sequence_id long, doc_id long, start long, ids array<int>"
    )
