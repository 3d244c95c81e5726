"""Near duplicates by fast similarity sketching, banding and exact verification.

Each document becomes the set of its distinct word shingles.  Documents with
equal sets form one class, of which the smallest id goes on alone.  A sketch of
``BINS`` coordinates is filled in rounds: in round i < BINS every shingle is
hashed to one bin, in round BINS + j all shingles go to bin j, and a value of
an earlier round wins over a later one.  So every coordinate is filled after
at most 2 * BINS rounds, also for a set of one shingle, and sets of many are
done after two or three.  Coordinates of two sets agree with the probability of
their Jaccard similarity.  Bands of four coordinates give candidates; every
link is confirmed on the full sets of 64-bit shingle hashes.

Only connectivity is asked for, so pairs are never written down.  Classes that
meet in any bucket, directly or over others, form a cluster; a cluster's sets go
to one task, or if they are more than ``UNIT_GRAMS`` shingles or ``UNIT_MEMBERS``
sets, in parts of that size to one task for every two parts.  There, pairs whose sketches agree enough
are confirmed on their full sets, the most alike first, and a pair that is
already connected is skipped; a task returns the links of a spanning forest,
fewer than it has members.  Nothing is capped.  With 32 bands of four, a pair
at similarity 0.85 is never a candidate with a probability of 5e-11, at 0.8 of
5e-8; the comparison of sketches (``AGREE`` standard deviations below the
similarity asked for) adds 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common, kernel

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Shingles and members of a part of a cluster, about.
UNIT_GRAMS, UNIT_MEMBERS = 1_500_000, 8_000
AGREE = 6.0
#: Bytes of a bit matrix of members and shingles, beyond which sets are compared by sorting.
BITS = 96 << 20
_U = np.uint64


def sketch(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x BINS sketches of the sets (values, owner); an empty set's are all ones."""
    best = np.full(n * BINS, np.iinfo(np.uint64).max, _U)
    has = np.zeros(n, bool)
    has[owner] = True
    for i in range(2 * BINS):
        h = kernel.mix(values + _U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = (h & _U((1 << 50) - 1)) | _U(i << 50)
        at = (h >> _U(57)).astype(np.int64) if i < BINS else i - BINS
        np.minimum.at(best, owner * BINS + at, rank)
        open_ = has & (best.reshape(n, BINS) == np.iinfo(np.uint64).max).any(1)
        if not open_.any():
            break
        if i in (0, 1, 2, 4, 8, 16, 32) or i % 64 == 0:
            left = open_[owner]
            values, owner = values[left], owner[left]
    return best.reshape(n, BINS)


def band_hashes(sketches: np.ndarray) -> np.ndarray:
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    total = np.zeros(parts.shape[:2], _U)
    for k in range(ROWS):
        total += kernel.mix(parts[:, :, k] + _U(k + 1)) * kernel._STEP[k]
    return kernel.mix(total + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, distinct shingle hashes, owner) for passes over a column of texts."""
    data, offsets = kernel.utf8(texts)
    for a, b in kernel.passes(offsets):
        w = kernel.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kernel.NON_SPACE, lower=True)
        values, owner = kernel.shingles(w.hashes(), w.first, words, whole=True)
        yield a, b, *kernel.distinct_per_owner(values, owner)


def _sketched(words: int):
    def run(batches):
        for batch in batches:
            for a, b, values, owner in shingle_sets(batch["_t"], words):
                n = b - a
                size = np.bincount(owner, minlength=n)
                sums = np.zeros((2, n), _U)
                if len(values):
                    at = np.flatnonzero(np.diff(owner, prepend=-1))
                    who = owner[at]
                    sums[0, who] = np.add.reduceat(values, at)
                    sums[1, who] = np.add.reduceat(kernel.mix(values), at)
                bands = band_hashes(sketch(values, owner, n)).view(np.int64)
                filled = size > 0
                offs = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_key"].slice(a, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(bands[filled].ravel())),
                    ],
                    ["_key", "n", "s1", "s2", "bands"],
                )

    return run


def _sets(words: int):
    """Full sets and, of each coordinate of the sketch, one byte."""

    def run(batches):
        for batch in batches:
            for a, b, values, owner in shingle_sets(batch["_t"], words):
                bytes_ = (kernel.mix(sketch(values, owner, b - a)) & _U(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_key"].slice(a, b - a),
                        kernel.lists(values.view(np.int64), owner, b - a),
                        pa.array([x.tobytes() for x in bytes_], pa.binary()),
                    ],
                    ["id", "grams", "sketch"],
                )

    return run


class _Forest:
    """Union-find over members; ``root`` is kept flat."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.root[a], self.root[b]
        if ra == rb:
            return False
        self.root[self.root == max(ra, rb)] = min(ra, rb)
        return True


def spanning_links(
    values: np.ndarray, first: np.ndarray, sketches: np.ndarray, part: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members whose sets are similar enough.

    Member i has the distinct ``values[first[i]:first[i+1]]``.  If ``part`` has
    two values, only pairs across them are compared.
    """
    n = len(first) - 1
    size = np.diff(first)
    vocabulary, code = np.unique(values, return_inverse=True)
    width = -(-len(vocabulary) // 8)
    bits = None
    if n * width <= BITS:
        bits = np.zeros((n, width), np.uint8)
        row = np.repeat(np.arange(n), size)
        np.bitwise_or.at(bits.reshape(-1), row * width + (code >> 3), np.left_shift(1, code & 7).astype(np.uint8))

    def common_grams(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if bits is not None:
            out = np.zeros(len(a), np.int64)
            step = max(1, (16 << 20) // max(width, 1))
            for k in range(0, len(a), step):
                out[k : k + step] = np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(1)
            return out
        who = np.arange(len(a)) * len(vocabulary)
        keys = np.concatenate(
            [np.repeat(who, size[x]) + np.concatenate([code[first[i] : first[i + 1]] for i in x]) for x in (a, b)]
        )
        keys.sort()
        return np.bincount(keys[1:][keys[1:] == keys[:-1]] // len(vocabulary), minlength=len(a))

    s = percent / 100
    least = BINS * s - AGREE * np.sqrt(BINS * s * (1 - s))
    forest, links = _Forest(n), []
    two = len(np.unique(part)) > 1
    by_coordinate = np.ascontiguousarray(sketches.T)
    for at in range(0, n, 128):
        rows = np.arange(at, min(at + 128, n))
        agree = np.zeros((len(rows), n), np.uint8)
        for c in by_coordinate:
            agree += c[rows][:, None] == c
        good = (agree >= least) & (np.arange(n) > rows[:, None])
        good &= 100 * np.minimum(size[rows][:, None], size) >= percent * np.maximum(size[rows][:, None], size)
        if two:
            good &= part[rows][:, None] != part
        a, b = np.nonzero(good)
        order = np.argsort(-agree[a, b].astype(np.int16), kind="stable")
        a, b = rows[a[order]], b[order]
        step = 64
        while len(a):
            both = common_grams(a[:step], b[:step])
            hit = 100 * both >= percent * (size[a[:step]] + size[b[:step]] - both)
            for i, j in zip(a[:step][hit].tolist(), b[:step][hit].tolist()):
                if forest.join(i, j):
                    links.append((i, j))
            a, b = a[step:], b[step:]
            apart = forest.root[a] != forest.root[b]
            a, b = a[apart], b[apart]
            step = min(2 * step, 4096)
    return links


def _linked(percent: int):
    """Over rows (unit, side, id, grams, sketch) sorted by unit: spanning links of each unit."""

    def solve(held):
        ids = np.concatenate([h[0] for h in held])
        side = np.concatenate([h[1] for h in held])
        values = np.concatenate([h[2] for h in held])
        first = np.concatenate([[0], np.cumsum(np.concatenate([h[3] for h in held]))])
        sketches = np.concatenate([h[4] for h in held])
        links = spanning_links(values, first, sketches, side, percent) if len(ids) > 1 else []
        a, b = (ids[[x[k] for x in links]] if links else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            unit = batch["unit"].to_numpy()
            if not len(unit):
                continue
            ids, side = batch["id"].to_numpy(), batch["side"].to_numpy()
            grams = batch["grams"]
            offsets = grams.offsets.to_numpy()
            values = grams.values.to_numpy()
            data, _ = kernel.utf8(batch["sketch"])
            sketches = data.reshape(-1, BINS)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if held and unit[a] != last:
                    yield solve(held)
                    held = []
                last = unit[a]
                held.append((
                    ids[a:b], side[a:b], values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]), sketches[a:b]
                ))
        if held:
            yield solve(held)

    return run


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, c): each class and the smallest id that it is connected with so far."""
    linked = common.components(links).withColumnRenamed("component", "c")
    return common.saved(
        classes.select("id").join(linked, "id", "left").select("id", F.coalesce("c", "id").alias("c")), "labels"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """Connected groups of near duplicates.

    Returns per row ``id_col``, n_shingles, component_id (smallest id of the
    group, the row's own if it is alone) and kept (whether the row is that one).
    Words are runs of non-space characters after lower-casing A-Z.  Null, empty
    and blank texts have no shingles and stay alone; a text of fewer words than
    a shingle has one, its whole sequence.  Rows that repeat an id or have none
    count as rows of their own (the first of them in id, text order stands for
    the others); component_id then is the id of the standing row.  An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    keyed, same = common.row_keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_id", "_t")
    s = common.saved(
        keyed.select("_key", "_t").mapInArrow(
            _sketched(words), "_key long, n long, s1 long, s2 long, bands array<long>"
        ),
        "sketches",
    )
    classes = s.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("_key").alias("id"))
    # written first: the join then reads both sides from shuffles of its own, and a class of very many copies is split
    classes = common.saved(classes, "class-ids")
    own = common.saved(
        s.where("n > 0").select("_key", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).select("_key", "id", "n"),
        "classes",
    )
    rows = (
        s.where("n > 0")
        .join(own.where("_key = id").select("_key"), "_key", "left_semi")
        .select(F.col("_key").alias("id"), "n", F.explode("bands").alias("band"))
    )
    rows = common.saved(rows, "bands")
    buckets = rows.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    met = common.saved(rows.join(buckets, "band"), "buckets")
    wanted = common.saved(met.select(F.col("id").alias("_key")).distinct(), "candidates")
    sets = common.saved(
        keyed.select("_key", "_t")
        .join(common.if_small(wanted), "_key", "left_semi")
        .mapInArrow(_sets(words), "id long, grams array<long>, sketch binary"),
        "sets",
    )
    cluster = common.components(met.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    member = common.saved(
        sets.join(cluster, "id").withColumn("n", F.size("grams")).select("id", "component", "n", "grams", "sketch"),
        "clusters",
    )
    parts = member.groupBy("component").agg(
        F.greatest(F.ceil(F.sum("n") / UNIT_GRAMS), F.ceil(F.count("*") / UNIT_MEMBERS)).cast("int").alias("parts")
    )
    own_part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    units = (
        member.join(parts, "component")
        .withColumn("side", own_part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.xxhash64("component", F.least("side", "other"), F.greatest("side", "other")).alias("unit"),
            "side",
            "id",
            "grams",
            "sketch",
        )
    )
    links = common.saved(
        units.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(_linked(percent), "a long, b long"),
        "links",
    )
    label = _labels(own.where("_key = id").select("id"), links)
    placed = keyed.select("_key", "_id").join(own.join(label, "id").select("_key", "n", "c"), "_key", "left")
    placed = placed.withColumn("c", F.coalesce("c", "_key")).withColumn("n", F.coalesce("n", F.lit(0)))
    if same:
        component = placed.withColumn("_cid", F.col("c"))
    else:
        component = placed.join(keyed.select(F.col("_key").alias("c"), F.col("_id").alias("_cid")), "c")
    return component.select(
        F.col("_id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.col("_cid").cast("long").alias("component_id"),
        (F.col("_key") == F.col("c")).alias("kept"),
    )
