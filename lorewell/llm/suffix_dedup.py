"""Removal of long repeated byte strings over a whole corpus.

A byte goes if it is covered by a string of ``length`` bytes that also starts
earlier (in a document of a smaller id, or earlier in the same one).

1. Each string of ``length`` bytes (a window) belongs to the place of the
   smallest hash of a ``SEED``-byte substring in it.  Consecutive windows of one
   such place form a piece; its windows' equals, wherever they are, belong to
   pieces of the same seed hash.  About one piece starts every 35 bytes.  A map
   task keeps the first of equal pieces and reports the others as covered, so a
   passage that a third of all documents share sends one row a task and not one
   a document.
2. Pieces are sorted by seed hash and content.  Of equal pieces all but the
   first are covered whole.  Where a seed has several different pieces, the
   first of each needs a closer look; all others are done.
3. Those pieces' bytes are gathered by seed into blocks.  Each block gets its
   suffix order and Burrows-Wheeler transform; breadth-first backward extension
   of suffix intervals, beginning with the empty string, finds the boundaries
   of common prefix 0, 1, 2, ... and stops at ``length``.  What no boundary
   splits shares ``length`` bytes or more, so each interval that is left is one
   repeated string, and all its occurrences but the first are covered.
4. Seeds with more than ``HOT_PIECES`` different pieces (the edges of passages
   that very many documents share) are not put into one block: their windows
   are hashed one by one and grouped, with partial minima in the map tasks.

Texts are joined with the covered ranges by id at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common, kernel

SEED = 32
HOT_PIECES = 2000
#: Bytes of pieces in one block, about; a block has one seed's pieces at least.
BLOCK_BYTES = 1 << 20
#: Pieces that a map task gathers before it looks for equal ones among them.
GATHER = 600_000
_U = np.uint64


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, seed hash, content hash) of a pass of texts."""
    rolling = kernel.RollingHash(data)
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    row, first, count, seed = kernel.window_seeds(rolling.windows(SEED), offsets[:-1], windows, length - SEED + 1)
    start = offsets[:-1][row] + first
    return row, first, count, seed, rolling.ranges(start, start + count + length - 1)


def _local_firsts(seed, content, doc, start):
    """Mark the first of equal pieces."""
    order = np.lexsort((start, doc, content, seed))
    same = np.zeros(len(order), bool)
    s, c = seed[order], content[order]
    same[1:] = (s[1:] == s[:-1]) & (c[1:] == c[:-1])
    first = np.ones(len(order), bool)
    first[order[same]] = False
    return first


_PIECES = "seed long, content long, _key long, start long, n int, covered boolean"


def _emit(seed, content, doc, start, count, covered):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(seed.view(np.int64)),
            pa.array(content.view(np.int64)),
            pa.array(doc),
            pa.array(start),
            pa.array(count.astype(np.int32)),
            pa.array(covered),
        ],
        ["seed", "content", "_key", "start", "n", "covered"],
    )


def _find_pieces(length: int):
    def flush(held):
        seed, content, doc, start, count = (np.concatenate(x) for x in zip(*held))
        first = _local_firsts(seed, content, doc, start)
        # what is covered already only passes through the next shuffle: spread it by document
        seed = np.where(first, seed, kernel.mix(doc.astype(_U)))
        for a in range(0, len(seed), 100_000):
            b = slice(a, a + 100_000)
            yield _emit(seed[b], content[b], doc[b], start[b], count[b], ~first[b])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            data, offsets = kernel.utf8(batch["_t"])
            keys = batch["_key"].to_numpy(zero_copy_only=False)
            for a, b in kernel.passes(offsets):
                row, start, count, seed, content = pieces(
                    data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length
                )
                held.append((seed, content, keys[a:b][row], start, count))
                n += len(row)
                if n >= GATHER:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


_JUDGED = "seed long, _key long, start long, n int, covered boolean"


def _judge(batches):
    """Over rows sorted by (covered, seed, content, _key, start): covered pieces, and firsts of seeds with several."""
    last_seed = last_content = None
    waiting = None  # the first piece of the last seed, until a different one shows up
    for batch in batches:
        seed, content, doc, start = (batch[i].to_numpy() for i in range(4))
        n, covered = batch[4].to_numpy(), batch[5].to_numpy(zero_copy_only=False)
        if not len(seed):
            continue
        new_seed = np.ones(len(seed), bool)
        new_seed[1:] = (seed[1:] != seed[:-1]) | (covered[1:] != covered[:-1])
        new = new_seed.copy()
        new[1:] |= content[1:] != content[:-1]
        if last_seed is not None and not covered[0]:
            new_seed[0] = seed[0] != last_seed
            new[0] = new_seed[0] or content[0] != last_content
        again = ~new & ~covered
        # a first of its content whose seed has another content before or after it
        firsts = np.flatnonzero(new & ~covered)
        many = np.zeros(len(seed), bool)
        later = firsts[~new_seed[firsts]]
        many[later] = True
        before = firsts[np.searchsorted(firsts, later) - 1]
        inside = np.searchsorted(firsts, later) > 0
        many[before[inside]] = True
        extra = None
        if waiting is not None and len(firsts) and not new_seed[firsts[0]]:
            extra, waiting = waiting, None
        if len(firsts):
            k = firsts[-1]
            waiting = (seed[k], doc[k], start[k], n[k]) if new_seed[k] else None
        if not covered[-1]:
            last_seed, last_content = seed[-1], content[-1]
        out = np.flatnonzero(covered | again | many)
        cols = [seed[out], doc[out], start[out], n[out].astype(np.int32), (covered | again)[out]]
        if extra is not None:
            cols = [np.append(c, e).astype(c.dtype) for c, e in zip(cols, (*extra, False))]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["seed", "_key", "start", "n", "covered"])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a byte string in the order of the ``depth`` (at least) bytes that follow them, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for i in range(8):
        key = (key << _U(8)) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    k = key[order]
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    known = 8
    while known < depth and rank.max() < n - 1:
        follow = np.full(n, -1, np.int64)
        if known < n:
            follow[: n - known] = rank[known:]
        pair = rank * (n + 1) + follow + 1
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], p[1:] != p[:-1]]))
        known *= 2
    return order


def repeated_intervals(text: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix intervals whose members share ``length`` symbols.

    ``split[i]`` says that suffixes i-1 and i differ within the first
    ``length`` symbols.  Level by level, intervals of strings of l symbols are
    extended by one symbol to the left; the end of an extended interval that
    was not yet known to be a boundary has a common prefix of exactly l.
    """
    n = len(text)
    symbols, code = np.unique(text, return_inverse=True)
    bwt = code[order - 1]  # the text is taken as a circle; separators keep strings apart
    keys = np.sort(bwt.astype(np.int64) * n + np.arange(n))  # symbol by symbol, the places where it stands
    below = np.searchsorted(keys, np.arange(len(symbols) + 1) * n)
    last = np.empty(n, np.int64)  # last-to-first mapping
    last[keys % n] = np.arange(n)
    split = np.zeros(n + 1, bool)
    split[0] = split[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        wide = hi - lo > len(symbols)
        new_lo, new_hi = [], []
        if wide.any():
            a = np.repeat(lo[wide], len(symbols))
            b = np.repeat(hi[wide], len(symbols))
            s = np.tile(np.arange(len(symbols)), int(wide.sum()))
            a, b = np.searchsorted(keys, s * n + a), np.searchsorted(keys, s * n + b)
            some = b > a
            new_lo.append(a[some])
            new_hi.append(b[some])
        if not wide.all():
            a, size = lo[~wide], (hi - lo)[~wide]
            who = np.repeat(np.arange(len(a)), size)
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(len(who))
            s = bwt[at]
            if size.max() > 1:
                pair = np.argsort(who * len(symbols) + s, kind="stable")
                who, s, at = who[pair], s[pair], at[pair]
            begins = np.ones(len(who), bool)
            begins[1:] = (who[1:] != who[:-1]) | (s[1:] != s[:-1])
            ends = np.append(begins[1:], True)
            new_lo.append(last[at[begins]])
            new_hi.append(last[at[ends]] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~split[hi]
        lo, hi = lo[fresh], hi[fresh]
        split[hi] = True
        if not len(hi):
            break
    edge = np.flatnonzero(split)
    big = np.flatnonzero(np.diff(edge) > 1)
    return edge[big], edge[big + 1]


def covered_windows(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int):
    """(doc, window) pairs of the parts whose ``length`` bytes stand earlier in another part."""
    n_parts = len(parts)
    sizes = np.fromiter(map(len, parts), np.int64, n_parts)
    joined = b"\xff".join(parts) + b"\xff"  # 0xFF never stands in UTF-8
    text = np.frombuffer(joined, np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    lo, hi = repeated_intervals(text, order := suffix_order(text, length), length)
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(lo)), hi - lo)
    at = order[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(who))]
    part = np.searchsorted(begins, at, "right") - 1
    whole = at - begins[part] + length <= sizes[part]  # the shared string does not run over a separator
    who, at, part = who[whole], at[whole], part[whole]
    d, w = doc[part], start[part] + at - begins[part]
    pick = np.lexsort((w, d, who))
    who, d, w = who[pick], d[pick], w[pick]
    later = np.zeros(len(who), bool)
    later[1:] = who[1:] == who[:-1]
    return d[later], w[later]


def _resolve(length: int):
    """Over rows (seed, _key, start, bytes) sorted by seed: covered windows, block by block."""

    def solve(held):
        seed, doc, start, parts = (list(x) for x in zip(*held))
        parts = [p for x in parts for p in x]
        d, w = covered_windows(parts, np.concatenate(doc), np.concatenate(start), length)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(w)], ["_key", "start"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            seed = batch["seed"].to_numpy()
            doc, start = batch["_key"].to_numpy(), batch["start"].to_numpy()
            parts = batch["bytes"].to_pylist()
            edge = np.flatnonzero(np.diff(seed)) + 1
            for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(seed)]])):
                if b == a:
                    continue
                if held and size >= BLOCK_BYTES and held[-1][0] != seed[a]:
                    yield solve(held)
                    held, size = [], 0
                held.append((seed[a], doc[a:b], start[a:b], parts[a:b]))
                size += sum(map(len, parts[a:b]))
        if held:
            yield solve(held)

    return run


def _cut(length: int):
    """Cut pieces out of their texts; hot seeds' pieces become hashes of their windows."""

    def run(batches):
        for batch in batches:
            data, offsets = kernel.utf8(batch["_t"])
            keys = batch["_key"].to_numpy()
            out = [[], [], [], [], []]
            for i, list_ in enumerate(batch["cuts"].to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                raw = text.tobytes()
                for c in list_:
                    a, b = c["start"], c["start"] + c["n"] + length - 1
                    if not c["hot"]:
                        for col, v in zip(out, (c["seed"], keys[i], a, raw[a:b], False)):
                            col.append(v)
                    else:
                        h = kernel.RollingHash(text[a:b]).windows(length).view(np.int64)
                        for k, v in enumerate(h.tolist()):
                            for col, x in zip(out, (v ^ c["seed"], keys[i], a + k, None, True)):
                                col.append(x)
                if len(out[0]) >= 20_000:
                    yield _cut_batch(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _cut_batch(out)

    return run


def _cut_batch(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(out, kinds)], ["seed", "_key", "start", "bytes", "hot"]
    )


def _keep(with_kept: bool):
    def run(batches):
        for batch in batches:
            data, offsets = kernel.utf8(batch["_t"])
            spans = batch["spans"]
            lists = spans.to_pylist()
            removed, n_spans, digest, kept = [], [], [], []
            for i, ranges in enumerate(lists):
                text = data[offsets[i] : offsets[i + 1]]
                if not ranges:
                    removed.append(0)
                    n_spans.append(0)
                    raw = text.tobytes()
                else:
                    depth = np.zeros(len(text) + 1, np.int32)
                    r = np.array([(x["start"], x["stop"]) for x in ranges], np.int64)
                    np.add.at(depth, r[:, 0], 1)
                    np.add.at(depth, r[:, 1], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed.append(int(gone.sum()))
                    n_spans.append(len(kernel.runs(gone)[0]))
                    raw = text[~gone].tobytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                if with_kept:
                    kept.append(raw)
            cols = [
                batch["_id"],
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(digest, pa.string()),
            ]
            names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def repeated_ranges(keyed: DataFrame, length: int = 100) -> DataFrame:
    """(_key, start, stop): byte ranges of ``keyed(_key, _t)`` to remove; they may overlap."""
    found = keyed.mapInArrow(_find_pieces(length), _PIECES)
    judged = common.saved(
        found.repartition("seed")
        .sortWithinPartitions("covered", "seed", "content", "_key", "start")
        .mapInArrow(_judge, _JUDGED),
        "pieces",
    )
    open_ = judged.where("NOT covered")
    hot = common.saved(open_.groupBy("seed").count().where(f"count > {HOT_PIECES}").select("seed"), "hot-seeds")
    open_ = open_.join(hot.withColumn("hot", F.lit(True)), "seed", "left")
    cuts = open_.groupBy("_key").agg(
        F.collect_list(F.struct("seed", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("cuts")
    )
    cut = common.saved(
        keyed.join(cuts, "_key")
        .select("_key", "_t", "cuts")
        .mapInArrow(_cut(length), "seed long, _key long, start long, bytes binary, hot boolean"),
        "cut",
    )
    windows = (
        cut.where("NOT hot")
        .select("seed", "_key", "start", "bytes")
        .repartition("seed")
        .sortWithinPartitions("seed")
        .mapInArrow(_resolve(length), "_key long, start long")
    )
    hot_rows = cut.where("hot").select("seed", "_key", "start")
    firsts = hot_rows.groupBy("seed").agg(
        F.min(F.struct("_key", "start")).alias("f"), F.count("*").alias("times")
    )
    # written first: the join then reads both sides from shuffles of its own, and a window of very many rows is split
    firsts = common.saved(firsts.where("times > 1").select("seed", "f"), "hot-windows")
    hot_windows = (
        hot_rows.join(firsts, "seed")
        .where("_key <> f._key OR start <> f.start")
        .select("_key", "start")
    )
    whole = judged.where("covered").select(
        "_key", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop")
    )
    one = windows.unionByName(hot_windows).select("_key", "start", (F.col("start") + length).alias("stop"))
    return whole.unionByName(one)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_kept: bool = True
) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers.

    Returns per row ``id_col``, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, if asked for, kept (the bytes that are left, as binary
    since a cut may fall into a character).  Null and empty texts have no bytes; texts
    shorter than ``length`` lose nothing.  Rows that repeat an id or have none
    are documents of their own, in the order of id (null first), then text.
    ``length`` must be at least ``SEED`` + 1.  Other columns are ignored; an
    empty table gives an empty result.
    """
    if length <= SEED:
        raise ValueError(f"length must be over {SEED}")
    keyed, _ = common.row_keyed(
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")), "_id", "_t"
    )
    spans = repeated_ranges(keyed.select("_key", "_t"), length)
    spans = spans.groupBy("_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = keyed.join(spans, "_key", "left").select("_id", "_t", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    return out.mapInArrow(
        _keep(with_kept),
        f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept,
    ).withColumnRenamed("_id", id_col)
