"""Packing of token pieces into sequences by bounded-space online best fit.

Only documents longer than a sequence are cut, into pieces of full length; what
is left over comes first.  Pieces arrive in id order.  A packer has a fixed
number of open bins; bit f of one integer says whether a bin with f free places
is open, so the best fit is the lowest set bit at or above the piece's length.
When too many bins are open, the fullest closes first.  Each partition of
``PIECES`` pieces or so packs for itself, which leaves a few bins part-filled
at its end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common, tokens

#: Pieces that one packer gets, about.
PIECES = 60_000
OPEN_BINS = 2048


class BestFit:
    """Places lengths, one after another; bins are numbered as they open."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        self.size, self.limit = size, open_bins
        self.mask = self.n_open = self.n_bins = 0
        self.by_free: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece."""
        fits = self.mask >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            chosen = self._take(free)
        else:
            free, chosen = self.size, self.n_bins
            self.n_bins += 1
            if self.n_open >= self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(chosen)
            self.mask |= 1 << left
            self.n_open += 1
        return chosen, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return chosen


def cuts(n_tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of one token or more; only the first may be short."""
    n_pieces = -(-n_tokens // size)
    doc = np.repeat(np.arange(len(n_tokens)), n_pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    short = n_tokens - (n_pieces - 1) * size  # length of the first piece
    start = np.where(piece == 0, 0, short[doc] + (piece - 1) * size)
    return doc, piece, start, np.where(piece == 0, short[doc], size)


_PIECE = "_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, size: int, with_ids: bool, cache: int):
    def run(batches):
        for batch in batches:
            for a, b, ids, offsets in tokens.encoded(batch["_t"], path, end_id, cache):
                doc, piece, start, length = cuts(np.diff(offsets), size)
                raw = memoryview(ids.astype("<u4")).cast("B")
                at = 4 * (offsets[doc] + start)
                parts = [raw[x:y] for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
                rows = pa.array(a + doc)
                cols = [
                    batch["_key"].take(rows),
                    batch["_id"].take(rows),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(list(map(zlib.crc32, parts)), pa.int64()),
                ]
                names = ["_key", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _pack(size: int, open_bins: int):
    def run(batches):
        packer = BestFit(size, open_bins)
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [packer.place(n) for n in batch["length"].to_pylist()]
            where = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where[:, 0] + first), pa.array(where[:, 1].copy())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    size: int = 1024,
    open_bins: int = OPEN_BINS,
    with_ids: bool = False,
    cache: int = tokens.CACHE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every token of every document in sequences of at most ``size`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and
    offset, and the ids as little-endian unsigned 32-bit integers if asked for.
    Texts are encoded whole; null and empty ones have the end id alone.  Rows
    that repeat an id or have none are packed as documents of their own.  An
    empty table gives an empty result; other columns are ignored.  ``cache``
    bounds the word pieces that a worker remembers, some 200 bytes each.
    """
    keyed, _ = common.row_keyed(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")), "_id", "_t"
    )
    schema = _PIECE + ", ids binary" * with_ids
    pieces = common.saved(
        keyed.select("_key", "_id", "_t").mapInArrow(_cut(vocabulary, end_id, size, with_ids, cache), schema), "token-pieces"
    )
    n = max(1, round(pieces.count() / PIECES))
    placed = (
        pieces.repartitionByRange(n, "_key", "piece")
        .sortWithinPartitions("_key", "piece")
        .mapInArrow(_pack(size, open_bins), schema + ", sequence_id long, offset long")
    )
    return placed.drop("_key")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack_documents(..., with_ids=True)``: sequence_id, n_tokens, ids and doc_ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        placed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
        .select(
            "sequence_id",
            "n_tokens",
            F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
            F.col("p.doc_id").alias("doc_ids"),
        )
    )
