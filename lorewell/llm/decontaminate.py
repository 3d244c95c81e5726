"""Benchmark passages in training text, found by rare seeds and scored by alignment.

1. Document frequencies of the benchmark's n-grams are counted over the whole
   corpus; each task adds up its own counts first.
2. Of every ``spread`` neighbouring n-grams of an item the rarest in the corpus
   is a seed, so each stretch of an item has seeds however common its words are.
3. A second scan joins documents with the seeds.  Where one hits, the document's
   words around that diagonal and the item's words are aligned
   (Smith-Waterman over words: match 2, mismatch -1, gap -1), so copies
   with words changed, dropped or added score in proportion to what is left.

Three-word seeds stand in nearly every copy that scores half or more: with a
third of all words of 16 to 60 replaced, dropped or doubled, 998 to 1000 of 1000
such copies are found.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, which is what
a task holds in memory; documents never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common, kernel

BLOCK_WORDS = 2_000_000
_U = np.uint64


class Items:
    """Words and n-grams of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        self.ids, self.n = ids, n
        data, offsets = kernel.utf8(pa.array([t or "" for t in texts], pa.string()))
        w = kernel.Words(data, offsets, kernel.ALNUM, lower=True)
        self.words, self.first = w.hashes(), w.first
        self.grams, self.owner = kernel.shingles(self.words, w.first, n, whole=False)
        begins = np.searchsorted(self.owner, np.arange(len(ids)))
        self.place = np.arange(len(self.owner)) - begins[self.owner]
        self.keys = np.unique(self.grams)
        count = np.diff(w.first)
        # items of k < n words, by k: a table of their hashes, and the items of each hash
        self.short: dict[int, tuple[Lookup, np.ndarray, np.ndarray]] = {}
        for k in range(1, n):
            mine = np.flatnonzero(count == k)
            if len(mine):
                hashes = kernel.shingles(self.words, w.first, k, whole=False)
                grams = hashes[0][np.searchsorted(hashes[1], mine)]  # an item of k words has one
                order = np.argsort(grams, kind="stable")
                lookup = Lookup(np.unique(grams))
                self.short[k] = lookup, mine[order], np.append(np.searchsorted(grams[order], lookup.keys), len(mine))

    def seeds(self, frequency: np.ndarray, spread: int) -> "Seeds":
        """The rarest of each ``spread`` neighbouring n-grams; ``frequency`` goes with ``keys``."""
        df = frequency[np.searchsorted(self.keys, self.grams)]
        chosen = np.zeros(len(self.grams), bool)
        begins = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        for a, b in zip(begins[:-1], begins[1:]):
            for k in range(a, max(b - spread + 1, a + 1 if b > a else a)):
                chosen[k + int(np.argmin(df[k : min(k + spread, b)]))] = True
        at = np.flatnonzero(chosen)
        at = at[np.argsort(self.grams[at], kind="stable")]
        return Seeds(self, self.grams[at], self.owner[at], self.place[at])


class Lookup:
    """Places of hashes in a sorted array of distinct ones, by way of a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = min(24, max(16, int(len(keys) * 16).bit_length()))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(keys >> _U(64 - self.bits)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, places in ``keys``) of what is found."""
        hit = np.flatnonzero(self.maybe[(hashes >> _U(64 - self.bits)).astype(np.int64)])
        if not len(hit) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes[hit]), len(self.keys) - 1)
        real = self.keys[at] == hashes[hit]
        return hit[real], at[real]


class Seeds:
    def __init__(self, items: Items, grams: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.items, self.item, self.place = items, item, place
        self.lookup = Lookup(np.unique(grams))
        self.begin = np.searchsorted(grams, self.lookup.keys)
        self.end = np.searchsorted(grams, self.lookup.keys, "right")


def grams_of(column, n: int):
    data, offsets = kernel.utf8(column)
    for a, b in kernel.passes(offsets):
        w = kernel.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kernel.ALNUM, lower=True)
        words = w.hashes()
        grams, owner = kernel.shingles(words, w.first, n, whole=False)
        yield a, b, w, words, grams, owner


def align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of words: (score, end in left, end in right), ends exclusive.

    Rows are padded with 0 in ``left`` and 1 in ``right``, which match nothing.
    """
    n, width = right.shape
    ramp = np.arange(1, width + 1, dtype=np.int32)
    h = np.zeros((n, width + 1), np.int32)
    best, at_left, at_right = (np.zeros(n, np.int64) for _ in range(3))
    for i in range(left.shape[1]):
        same = np.where(right == left[:, i : i + 1], 2, -1).astype(np.int32)
        t = np.maximum(np.maximum(h[:, :-1] + same, h[:, 1:] - 1), 0)
        h[:, 1:] = np.maximum.accumulate(t + ramp, axis=1) - ramp  # gaps along the row
        top = h.argmax(1)
        value = h[np.arange(n), top]
        better = value > best
        best[better], at_left[better], at_right[better] = value[better], i + 1, top[better]
    return best, at_left, at_right


def _padded(words: np.ndarray, begin: np.ndarray, end: np.ndarray, fill: int) -> np.ndarray:
    size = end - begin
    out = np.full((len(begin), int(size.max(initial=1)) or 1), fill, _U)
    cols = np.arange(out.shape[1])
    inside = cols < size[:, None]
    out[inside] = words[(begin[:, None] + cols)[inside]]
    return out


def matches(seeds: Seeds, words: np.ndarray, first: np.ndarray, grams, owner, min_score: float):
    """(row, item, score, first word, last word) of the best alignment of each pair in a pass of documents."""
    items, n = seeds.items, seeds.items.n
    hit, key = seeds.lookup.find(grams)
    times = seeds.end[key] - seeds.begin[key]
    hit = np.repeat(hit, times)
    s = np.repeat(seeds.begin[key] - (np.cumsum(times) - times), times) + np.arange(len(hit))
    per = np.maximum(np.diff(first) - n + 1, 0)
    row = owner[hit]
    place = hit - (np.cumsum(per) - per)[row]
    item = seeds.item[s]
    length = np.diff(items.first)[item]
    slack = length // 3 + 4
    lo = np.maximum(place - seeds.place[s] - slack, 0)
    hi = np.minimum(place - seeds.place[s] + length + slack, np.diff(first)[row])
    # hits of one pair whose regions overlap are one region
    order = np.lexsort((lo, item, row))
    row, item, lo, hi = row[order], item[order], lo[order], hi[order]
    new = np.ones(len(row), bool)
    if len(row):
        group = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
        reach = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
        new[1:] = (group[1:] != group[:-1]) | (lo[1:] >= reach[:-1])
        at = np.flatnonzero(new)
        hi = np.maximum.reduceat(hi, at)
        row, item, lo = row[at], item[at], lo[at]
    found = []
    width = hi - lo
    by_size = np.argsort(width, kind="stable")
    for a in range(0, len(by_size), 512):
        p = by_size[a : a + 512]
        q0, q1 = items.first[item[p]], items.first[item[p] + 1]
        left = _padded(items.words, q0, q1, 0)
        right = _padded(words, first[row[p]] + lo[p], first[row[p]] + hi[p], 1)
        best, end_l, end_r = align(left, right)
        score = best / (2.0 * np.maximum(q1 - q0, 1))
        good = np.flatnonzero(score >= min_score)
        if len(good):  # the same backwards from the end gives the beginning
            g = p[good]
            l0 = items.first[item[g]]
            back_l = _padded(items.words, l0, l0 + end_l[good], 0)
            r0 = first[row[g]] + lo[g]
            back_r = _padded(words, r0, r0 + end_r[good], 1)
            for x, size in ((back_l, end_l[good]), (back_r, end_r[good])):
                for i, k in enumerate(size):
                    x[i, :k] = x[i, :k][::-1]
            _, _, len_r = align(back_l, back_r)
            last = lo[g] + end_r[good]
            found.append(np.stack([row[g], item[g], last - len_r, last - 1], 1).astype(np.float64))
            found[-1] = np.column_stack([found[-1], score[good]])
    if not found:
        return np.zeros((0, 5))
    f = np.concatenate(found)
    f = f[np.lexsort((f[:, 2], -f[:, 4], f[:, 1], f[:, 0]))]
    keep = np.ones(len(f), bool)
    keep[1:] = (f[1:, 0] != f[:-1, 0]) | (f[1:, 1] != f[:-1, 1])
    return f[keep]


def exact_matches(items: Items, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """As :func:`matches`, for the items of fewer words than a seed: first places where all their words stand."""
    found = [np.zeros((0, 5))]
    for k, (lookup, item_of, begin) in items.short.items():
        grams, owner = kernel.shingles(words, first, k, whole=False)
        hit, key = lookup.find(grams)
        per = np.maximum(np.diff(first) - k + 1, 0)
        row = owner[hit]
        place = hit - (np.cumsum(per) - per)[row]
        times = begin[key + 1] - begin[key]
        at = np.repeat(begin[key] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        rows = np.column_stack([np.repeat(row, times), item_of[at], np.repeat(place, times)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        rows = rows[new]
        found.append(np.column_stack([rows, rows[:, 2] + k - 1, np.ones(len(rows))]).astype(np.float64))
    return np.concatenate(found)


def _frequencies(items: Items):
    lookup = Lookup(items.keys)

    def run(batches):
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for *_, grams, owner in grams_of(batch["_t"], items.n):
                hit, key = lookup.find(grams)
                pair = np.unique(owner[hit] * len(items.keys) + key)
                total += np.bincount(pair % max(len(items.keys), 1), minlength=len(items.keys))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "docs"])

    return run


def _aligned(seeds: Seeds, min_score: float):
    def run(batches):
        for batch in batches:
            for a, b, w, words, grams, owner in grams_of(batch["_t"], seeds.items.n):
                f = matches(seeds, words, w.first, grams, owner, min_score)
                if seeds.items.short:
                    f = np.concatenate([f, exact_matches(seeds.items, words, w.first)])
                row = f[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_id"].slice(a, b - a).take(pa.array(row)),
                        pa.array([seeds.items.ids[int(i)] for i in f[:, 1]], pa.int64()),
                        pa.array(f[:, 4].copy()),
                        pa.array(f[:, 2].astype(np.int64)),
                        pa.array(f[:, 3].astype(np.int64)),
                    ],
                    ["_id", "item_id", "score", "first_word", "last_word"],
                )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    spread: int = 2,
    min_score: float = 0.5,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it has a copy of, edited or not.

    Returns ``id_col``, item_id, score (share of the item's full alignment
    score), first_word and last_word (of the best match, in words of ASCII
    letters and digits and anything beyond ASCII, from 0).  Items of fewer than
    ``n`` words match where all their words stand one after another; items and
    texts without words match nothing.  Rows that repeat an id give their pairs each; items that repeat
    an item_id too.  An empty table on either side gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, item_id long, score double, first_word long, last_word long"
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))  # by the rule that cuts them
    size = bench.agg(F.sum(words + 1)).first()[0] or 0
    blocks = -(-int(size) // BLOCK_WORDS)
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        rows = part.collect()  # at most about BLOCK_WORDS words
        if not rows:
            continue
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], n)
        counts = given.select("_t").mapInArrow(_frequencies(items), "gram long, docs long")
        frequency = np.zeros(len(items.keys), np.int64)
        for r in counts.groupBy("gram").agg(F.sum("docs").alias("docs")).collect():  # one row an n-gram of the block
            frequency[r["gram"]] = r["docs"]
        out = out.unionByName(given.mapInArrow(_aligned(items.seeds(frequency, spread), min_score), schema))
    return out.withColumnRenamed("_id", id_col)
