"""Many queries at once against blocks and concepts: keyword overlap, exact vector neighbours, fusion, contexts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.sources import scratch

# What a block's type adds to its score, and to its rank among equals.
TYPE_BONUS = {
    "idea_blocks": 0.25,
    "combination_hooks": 0.20,
    "transfer_targets": 0.20,
    "failure_modes": 0.20,
    "summary": 0.15,
    "core_hypothesis": 0.15,
}
RANK_BONUS = {"idea_blocks": 0.04, "combination_hooks": 0.03, "transfer_targets": 0.03, "failure_modes": 0.02}
_MOST_BONUS = max(v + RANK_BONUS.get(k, 0.0) for k, v in TYPE_BONUS.items())
RRF_K = 60
TOP_K, CONCEPT_TOP_K, FETCH_CONCEPTS, FETCH_BLOCKS, PER_ARTICLE = 8, 3, 4, 3, 3
#: Queries that one pass over the index holds in a task, and those whose vectors are multiplied together.
QUERY_BLOCK, QUERY_TILE = 20_000, 500
#: Rows of the index, and about how many of their tokens, that are looked at together; a token of one row in so many is common.
CHUNK_ROWS, CHUNK_TOKENS, COMMON = 1 << 14, 1 << 21, 16
#: From so many queries on, one article in so many gives each query a first limit.
MANY_QUERIES, FIRST_ARTICLES = 1000, 8
#: Vectors of the index that are multiplied together.
VECTOR_TILE = 1024


def _by_type(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, v in values.items():
        out = F.when(F.col("block_type") == name, v).otherwise(out)
    return out


def _query_blocks(queries: DataFrame) -> Iterator[list]:
    """Rows of queries, at most about ``QUERY_BLOCK`` at a time; they are computed once."""
    queries = scratch.kept(queries)
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    for k in range(n):
        yield (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) if n > 1 else queries).collect()


def _hashes(text: Column) -> Column:
    return F.transform(T.tokenize(text), lambda t: F.xxhash64(t))


def _rounded(value: float) -> int:
    """Millionths, halves up, as Spark rounds."""
    return int(Decimal(repr(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))


#: Types that have a bonus, and any other.
_TYPES = [*TYPE_BONUS, ""]


@lru_cache(maxsize=1 << 18)
def _rank_key(n: int, code: int) -> int:
    """What a block is ranked by, in millionths, from its query's size, the overlap and its type (overlap * types + type)."""
    overlap, kind = divmod(code, len(_TYPES))
    score = _rounded(overlap / n + TYPE_BONUS.get(_TYPES[kind], 0.0)) / 1e6
    return _rounded(score + RANK_BONUS.get(_TYPES[kind], 0.0))


#: Queries of up to so many tokens have their rank keys looked up in a table, which has a row for each overlap.
_TABLED = 512


@lru_cache(maxsize=_TABLED)
def _rank_table(n: int) -> np.ndarray:
    return np.array([_rank_key(n, c) for c in range((n + 1) * len(_TYPES))], np.int64)


def _rank_keys(n: int, overlap: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Rank keys of hits; types beyond those with a bonus are alike."""
    codes = overlap * len(_TYPES) + np.minimum(kind, len(_TYPES) - 1)
    if n <= _TABLED:
        return _rank_table(n)[codes]
    codes, at = np.unique(codes, return_inverse=True)
    return np.array([_rank_key(n, c) for c in codes.tolist()], np.int64)[at]


class _Asked:
    """Tokens of some queries: all their hashes, and each query's places among these."""

    def __init__(self, ids: np.ndarray, tokens: list[list[int]]):
        self.ids = ids
        self.size = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate([np.array(t, np.int64) for t in tokens] or [np.zeros(0, np.int64)])
        self.keys, at = np.unique(flat, return_inverse=True)
        self.end = np.cumsum(self.size)
        self.codes = at.reshape(-1).astype(np.int32)

    def tokens(self, q: int) -> np.ndarray:
        return self.codes[self.end[q] - self.size[q] : self.end[q]]


class _Chunk:
    """Rows of a task by those of their tokens that some query has; tokens of many rows as a bit a row."""

    def __init__(self, asked: _Asked, batch: pa.RecordBatch):
        self.n, places = batch.num_rows, batch["tokens"].offsets.to_numpy()
        token = batch["tokens"].values.to_numpy()[places[0] : places[-1]]
        row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(places))
        code = np.minimum(np.searchsorted(asked.keys, token), max(len(asked.keys) - 1, 0))
        real = asked.keys[code] == token if len(asked.keys) else np.zeros(len(token), bool)
        row, code = row[real], code[real]
        self.row = row[np.argsort(code, kind="stable")]
        rows_of = np.bincount(code, minlength=len(asked.keys))
        self.start = np.concatenate([[0], np.cumsum(rows_of)])
        common = np.flatnonzero(rows_of * COMMON > self.n)
        self.place = np.full(len(asked.keys), -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.has = np.zeros((len(common), self.n), np.uint8)
        for k, c in enumerate(common.tolist()):
            self.has[k, self.row[self.start[c] : self.start[c + 1]]] = 1

    def overlaps(self, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that share ``least`` of these tokens or more, how many)."""
        place = self.place[codes]
        common, rare = place[place >= 0], codes[place < 0]
        kind = np.uint8 if len(common) < 256 else np.int64  # of the sums of bits
        parts = [self.row[a:b] for a, b in zip(self.start[rare].tolist(), self.start[rare + 1].tolist(), strict=True) if b > a]
        shared = np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)
        if least > len(common):  # a row without the rare ones can't have enough
            hit = np.flatnonzero(shared >= least - len(common))
            shared = shared[hit] + self.has[np.ix_(common, hit)].sum(0, dtype=kind)
            good = shared >= least
            return hit[good], shared[good]
        if len(common):
            shared = shared + self.has[common].sum(0, dtype=kind)
        hit = np.flatnonzero(shared >= least)
        return hit, shared[hit]


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ``CHUNK_ROWS`` rows or about ``CHUNK_TOKENS`` tokens at a time."""
    held: list[pa.RecordBatch] = []
    n_rows = n_tokens = 0

    def taken() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        places, begin = batch["tokens"].offsets.to_numpy(), 0
        while begin < batch.num_rows:
            # one row at least, whatever its size
            end = int(np.searchsorted(places, places[begin] + CHUNK_TOKENS - n_tokens, side="right")) - 1
            end = min(max(end, begin + (not held)), begin + CHUNK_ROWS - n_rows, batch.num_rows)
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                n_rows, n_tokens = n_rows + end - begin, n_tokens + int(places[end] - places[begin])
            if end == begin or n_rows >= CHUNK_ROWS or n_tokens >= CHUNK_TOKENS:
                yield taken()
                held, n_rows, n_tokens = [], 0, 0
            begin = end
    if held:
        yield taken()


def _asked_blocks(queries: DataFrame):
    """Broadcast tables of the queries' tokens, at most about ``QUERY_BLOCK`` queries each."""
    for rows in _query_blocks(queries.select("query_id", _hashes(F.col("text")).alias("tokens"))):
        asked = _Asked(np.array([r["query_id"] for r in rows], np.int64), [r["tokens"] for r in rows])
        yield queries.sparkSession.sparkContext.broadcast(asked)


def _best(key: np.ndarray, name: np.ndarray, tie: np.ndarray, keep: int, per_name: int | None) -> np.ndarray:
    """Places of the rows that can be among the best ``keep`` when at most ``per_name`` of a name count, best first.

    Rows of a name can also lie in other tasks.  Of a list in order, each name
    that stands before a row has one row at least before it in the final list,
    so a row with ``keep`` names before it is out.
    """
    order = np.lexsort((tie, name, -key))
    if per_name is None:
        return order[:keep]
    of = name[order]
    by = np.argsort(of, kind="stable")
    place = np.empty(len(of), np.int64)  # among the rows of its name
    place[by] = np.arange(len(of)) - np.searchsorted(of[by], of[by])
    order, first = order[place < per_name], place[place < per_name] == 0
    return order[np.cumsum(first) - first < keep]


class _BestRows:
    """The rows of a task's whole run that can be among a query's best: rank key, name, and other numbers of each, the tie's first."""

    def __init__(self, keep: int, per_name: int | None, n_rest: int, floor: int = -1):
        self.keep, self.per_name = keep, per_name
        self.key, self.name, self.rest = np.zeros(0, np.int64), np.zeros(0, object), np.zeros((n_rest, 0))
        self.floor = floor  # rank keys below it can't be among the best any more

    def add(self, key: np.ndarray, code: np.ndarray, names: np.ndarray, rest: np.ndarray) -> None:
        """Rows with codes of their names in ``names``, which are in order."""
        good = np.flatnonzero(key >= self.floor)
        if not len(good):
            return
        good = good[_best(key[good], code[good], rest[0, good], self.keep, self.per_name)]
        key = np.concatenate([self.key, key[good]])
        name = np.concatenate([self.name, names[code[good]]])
        rest = np.concatenate([self.rest, rest[:, good]], 1)
        order = _best(key, np.unique(name, return_inverse=True)[1], rest[0], self.keep, self.per_name)
        self.key, self.name, self.rest = key[order], name[order], rest[:, order]
        n_names = len(order) if self.per_name is None else len(set(self.name.tolist()))
        if n_names >= self.keep:
            self.floor = max(self.floor, int(self.key[-1]))


def _highest(values: np.ndarray, n: int, slack: float = 0) -> np.ndarray:
    """Places of the n highest values, of those that equal the last one, and of those not more than ``slack`` below."""
    if len(values) <= n:
        return np.arange(len(values))
    return np.flatnonzero(values >= np.partition(values, len(values) - n)[len(values) - n] - slack)


def _least_overlap(n: int, floor: int) -> int:
    """Fewest shared tokens of a block that can have this rank key, of a query of n tokens."""
    return max(1, math.ceil(n * ((floor - 4) / 1e6 - _MOST_BONUS)))


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(names in order, each row's code, how many rows a name has at most)."""
    names, code = np.unique(np.array(column.to_pylist(), object), return_inverse=True)
    return names, code.reshape(-1), int(np.bincount(code.reshape(-1)).max())


def _passed_on(best: dict[int, _BestRows]) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """(places of queries, names, other numbers) of what was kept, some thousand rows at a time."""
    places = list(best)
    for k in range(0, len(places), 500):
        some = [best[q] for q in places[k : k + 500]]
        query = np.repeat(places[k : k + 500], [len(b.key) for b in some])
        if len(query):
            yield query, [x for b in some for x in b.name.tolist()], np.concatenate([b.rest for b in some], 1)


def _matching(asked, keep: int, per_article: int | None, floors=None):
    """Blocks of a task that can be among a query's best ``keep``, by overlap and type.

    ``floors`` is a broadcast of a rank key for each query under which no block is among its best.
    """

    def run(batches):
        a = asked.value
        floor = np.full(len(a.ids), -1) if floors is None else floors.value
        code_of = {name: t for t, name in enumerate(TYPE_BONUS)}
        best: dict[int, _BestRows] = {}
        for batch in _chunks(batches):
            chunk = _Chunk(a, batch)
            kind = np.array([code_of.setdefault(x, len(code_of)) for x in batch["block_type"].to_pylist()])
            names, article, most = _coded(batch["article_key"])
            ordinal = batch["ordinal"].to_numpy()
            for q in range(len(a.ids)):
                b, n = best.get(q), int(a.size[q])
                hit, shared = chunk.overlaps(a.tokens(q), _least_overlap(n, floor[q] if b is None else b.floor))
                if not len(hit):
                    continue
                key = _rank_keys(n, shared, kind[hit])
                some = _highest(key, keep * (most if per_article else 1))
                some = some[key[some] >= (floor[q] if b is None else b.floor)]
                if not len(some):
                    continue
                if b is None:
                    b = best[q] = _BestRows(keep, per_article, 3, int(floor[q]))
                hit = hit[some]
                b.add(key[some], article[hit], names, np.stack([ordinal[hit], kind[hit], shared[some]]))
        kinds = list(code_of)
        for query, name, rest in _passed_on(best):
            rest = rest.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a.ids[query]),
                    pa.array(name, pa.string()),
                    pa.array(rest[0].astype(np.int32)),
                    pa.array([kinds[t] for t in rest[1].tolist()], pa.string()),
                    pa.array(rest[2]),
                    pa.array(a.size[query]),
                ],
                ["query_id", "article_key", "ordinal", "block_type", "overlap", "n"],
            )

    return run


def _matching_concepts(asked, keep: int):
    """Concepts of a task that can be among a query's best ``keep``, by overlap and memory."""

    def run(batches):
        a = asked.value
        best: dict[int, _BestRows] = {}
        for batch in _chunks(batches):
            chunk = _Chunk(a, batch)
            memory = batch["memory"].to_numpy()
            names, slug, most = _coded(batch["slug"])
            highest = 2.0 * memory.max() + 4e-6
            for q in range(len(a.ids)):
                b = best.get(q)
                floor = -1 if b is None else b.floor
                hit, shared = chunk.overlaps(a.tokens(q), max(1, math.ceil(floor / 1e6 - highest)))
                if not len(hit):
                    continue
                score = shared + 2.0 * memory[hit]
                # scores are rounded: what could then equal the last place is looked at too
                some = _highest(score, keep * most, 4e-6)
                some = some[score[some] >= floor / 1e6 - 4e-6]
                if not len(some):
                    continue
                if b is None:
                    b = best[q] = _BestRows(keep, 1, 2)
                key = np.array([_rounded(x) for x in score[some].tolist()], np.int64)
                b.add(key, slug[hit[some]], names, np.stack([shared[some], memory[hit[some]]]))
        for query, name, rest in _passed_on(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.ids[query]), pa.array(name, pa.string()), pa.array(rest[0].astype(np.int64)), pa.array(rest[1])],
                ["query_id", "slug", "n", "memory"],
            )

    return run


def keyword_top(blocks: DataFrame, queries: DataFrame, limit: int, per_article: int | None = PER_ARTICLE) -> DataFrame:
    """The best ``limit`` blocks of each query by shared tokens, at most ``per_article`` of one article; with ``rank`` from 1.

    A block's score is the share of the query's tokens that it has, and its
    type's bonus.  Tasks compare token hashes of their blocks with all queries
    and pass on only blocks that can be among a query's best, so the pairs of
    queries and blocks that share a word are never written or shuffled.
    """
    given = blocks.select("article_key", F.col("ordinal").cast("int").alias("ordinal"), "block_type", _hashes(F.col("text")).alias("tokens"))
    given = scratch.kept(given)  # read again for each block of queries
    out = None
    for asked in _asked_blocks(queries):
        floors = None
        if len(asked.value.ids) >= MANY_QUERIES:
            first = given.where(F.pmod(F.xxhash64("article_key"), F.lit(FIRST_ARTICLES)) == 0)
            # each task passes on a full list a query
            first = first.coalesce(max(4, first.rdd.getNumPartitions() // FIRST_ARTICLES))
            floors = _floors(_scored(first, asked, limit, per_article), asked, limit, per_article)
        found = _scored(given, asked, limit, per_article, floors)
        out = found if out is None else out.unionByName(found)
    return scratch.kept(top_blocks(out, limit, per_article))  # few rows a query, which callers join more than once


def _scored(given: DataFrame, asked, limit: int, per_article: int | None, floors=None) -> DataFrame:
    """Blocks with their scores that can be among a query's best."""
    found = given.mapInArrow(
        _matching(asked, limit, per_article, floors),
        "query_id long, article_key string, ordinal int, block_type string, overlap long, n long",
    )
    score = F.round(F.col("overlap") / F.col("n") + _by_type(TYPE_BONUS), 6)
    return found.select("query_id", "article_key", "ordinal", "block_type", score.alias("score"))


def _floors(scored: DataFrame, asked, limit: int, per_article: int | None):
    """Broadcast rank keys, in the order of the queries, of the last places of full lists; more blocks can only raise them."""
    rank = F.round(F.col("score") + _by_type(RANK_BONUS), 6)
    last = top_blocks(scored, limit, per_article).groupBy("query_id").agg(F.min(rank).alias("least"), F.count("*").alias("found"))
    known = {r["query_id"]: _rounded(r["least"]) for r in last.where(F.col("found") == limit).collect()}  # a number a query
    return scored.sparkSession.sparkContext.broadcast(np.array([known.get(q, -1) for q in asked.value.ids.tolist()], np.int64))


def top_blocks(scored: DataFrame, limit: int, per_article: int | None = PER_ARTICLE) -> DataFrame:
    """The best ``limit`` blocks of each query, at most ``per_article`` of one article; with ``rank`` from 1."""
    order = [F.desc(F.round(F.col("score") + _by_type(RANK_BONUS), 6)), F.asc("article_key"), F.asc("ordinal")]
    if per_article:
        w = Window.partitionBy("query_id", "article_key").orderBy(*order)
        scored = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_article).drop("_n")
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def vector_scores(index: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank): the ``n`` nearest of ``index(id, embedding)`` by cosine similarity, exactly.

    Each task keeps the best n of all its rows and passes on no more; the rest
    is a ranking of few rows a task.  Queries are taken in blocks and vectors in
    tiles, which bounds what a task holds.  Rows without a vector, or with one
    of another length than the queries', match nothing.
    """
    out = None
    for rows in _query_blocks(queries.where("embedding IS NOT NULL").select("query_id", "embedding")):
        ids, unit = unit_queries(rows)
        shared = index.sparkSession.sparkContext.broadcast((ids, unit))  # at most QUERY_BLOCK vectors
        fits = index.where(F.size("embedding") == unit.shape[1]) if len(rows) else index.limit(0)
        found = fits.select("id", "embedding").mapInArrow(_nearest(shared, n), "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return scratch.kept(nearest_of(out, n))


def nearest_of(found: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of ``found(query_id, id, score)`` for each query; of equal scores the smallest ids."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size == 0, 1, size)


def unit_queries(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of collected queries."""
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix = np.array([r["embedding"] for r in rows], np.float64) if rows else np.zeros((0, 1))
    return ids, unit_rows(matrix)


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    return unit_rows(batch["embedding"].flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1))


class BestVectors:
    """The best n rows of each query so far, by score and then id."""

    def __init__(self, n_queries: int, n: int):
        self.n = n
        self.score = np.full((n_queries, n), -1.0)
        self.id = np.full((n_queries, n), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (places) against rows with these ids; rows scored below 0 are none."""
        open_ = (scores >= self.score[queries, -1:]).any(1)
        queries, scores = queries[open_], scores[open_]
        if not len(queries):
            return
        score = np.concatenate([self.score[queries], scores], 1)
        id_ = np.concatenate([self.id[queries], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((id_, -score), axis=1)[:, : self.n]
        self.score[queries] = np.take_along_axis(score, order, 1)
        self.id[queries] = np.take_along_axis(id_, order, 1)

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        real = self.score >= 0
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.broadcast_to(query_ids[:, None], real.shape)[real]),
                pa.array(self.id[real]),
                pa.array(self.score[real]),
            ],
            ["query_id", "id", "score"],
        )


def cosines(unit: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Similarities, not below 0, to six places."""
    return np.round(np.maximum(unit @ x.T, 0), 6)


def _nearest(shared, n: int):
    def run(batches):
        ids, unit = shared.value
        best = BestVectors(len(ids), n)
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTOR_TILE):
                part = batch.slice(begin, VECTOR_TILE)
                x, at = vectors_of(part), part["id"].to_numpy()
                for a in range(0, len(ids), QUERY_TILE):
                    places = np.arange(a, min(a + QUERY_TILE, len(ids)))
                    best.add(places, cosines(unit[places], x), at)
        yield best.rows(ids)

    return run


def vector_top(near: DataFrame, index: DataFrame, allowed: DataFrame, limit: int, per_article: int | None = PER_ARTICLE) -> DataFrame:
    """Neighbours ``near(query_id, id, score)`` of the whole index that are blocks of ``allowed(article_key)``, ranked as blocks.

    The index names each id's article, ordinal and type; wiki blocks among the
    neighbours fall out here, after the fetch.
    """
    named = near.join(index.select("id", "article_key", "ordinal", "block_type"), "id").join(
        allowed.select("article_key").distinct(), "article_key", "left_semi"
    )
    return top_blocks(named.select("query_id", "article_key", "ordinal", "block_type", "score"), limit, per_article)


def rrf_fusion(*ranked: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of lists (query_id, article_key, ordinal, block_type, rank)."""
    keys = ["query_id", "article_key", "ordinal", "block_type"]
    all_ = ranked[0].select(*keys, "rank")
    for r in ranked[1:]:
        all_ = all_.unionByName(r.select(*keys, "rank"))
    fused = all_.groupBy(*keys).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top_blocks(fused, limit, per_article=None)


def _memory(state: DataFrame) -> DataFrame:
    """(slug, memory, hints) of ``state``; conflicts may be a number or a list."""
    conflicts = F.col("conflicts")
    if state.schema["conflicts"].dataType.typeName() == "array":
        conflicts = F.size(conflicts)
    score = T.memory_score(F.col("confidence"), F.col("importance"), F.col("freshness"), F.col("source_count"), conflicts)
    return state.select("slug", score.alias("memory"), F.col("retrieval_hints").alias("hints"))


def _top_concepts(scored: DataFrame, k: int) -> DataFrame:
    """The best k concepts of each query, each once; of equal scores the first slug."""
    once = Window.partitionBy("query_id", "slug").orderBy(F.desc("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "slug")
    first = scored.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def concepts_by_vector(near: DataFrame, index: DataFrame, concepts: DataFrame, state: DataFrame, k: int = CONCEPT_TOP_K) -> DataFrame:
    """(query_id, slug, score, rank): half similarity and half memory, over stable concepts' blocks.

    ``near(query_id, id, score)`` holds the ``FETCH_CONCEPTS * k`` nearest of the
    index's stable concept blocks, see :func:`stable_concept_blocks`; a concept
    without state has no memory, and one that is gone is left out.
    """
    found = near.join(index.select("id", "slug"), "id").join(concepts.select("slug").distinct(), "slug", "left_semi")
    scored = found.join(_memory(state), "slug", "left").select(
        "query_id", "slug", F.round(0.5 * F.col("score") + 0.5 * F.coalesce("memory", F.lit(0.0)), 6).alias("score")
    )
    return _top_concepts(scored, k)


def stable_concept_blocks(index: DataFrame) -> DataFrame:
    return index.where("kb_layer = 'wiki_concept' AND status = 'stable'")


def concepts_by_words(concepts: DataFrame, queries: DataFrame, state: DataFrame, k: int = CONCEPT_TOP_K) -> DataFrame:
    """(query_id, slug, score, rank): shared tokens and twice the memory, over stable concepts that share a token.

    A concept's words are its title, its state's hints (without state its
    aliases and title), and 200 characters of its definition.  As in
    :func:`keyword_top`, tasks pass on only concepts that can be among a query's best.
    """
    stable = concepts.where("status = 'stable'").join(_memory(state), "slug", "left")
    own = F.concat(F.col("aliases"), F.array("title"))
    text = F.concat_ws(" ", "title", F.coalesce("hints", own), F.substring(F.coalesce("definition", F.lit("")), 1, 200))
    given = stable.select("slug", F.coalesce("memory", F.lit(0.0)).alias("memory"), _hashes(text).alias("tokens"))
    given = scratch.kept(given)  # read again for each block of queries
    out = None
    for asked in _asked_blocks(queries):
        found = given.mapInArrow(_matching_concepts(asked, k), "query_id long, slug string, n long, memory double")
        out = found if out is None else out.unionByName(found)
    return scratch.kept(_top_concepts(out.select("query_id", "slug", F.round(F.col("n") + 2.0 * F.col("memory"), 6).alias("score")), k))


def concepts_first(by_vector: DataFrame | None, by_words: DataFrame) -> DataFrame:
    """Concepts by vector where a query has some, else by words."""
    if by_vector is None:
        return by_words
    return by_vector.unionByName(by_words.join(by_vector.select("query_id").distinct(), "query_id", "left_anti"))


def exclude_cited(candidates: DataFrame, hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """Candidates without articles that are sources of a query's surfaced concepts.

    ``concepts`` list their sources, or are (slug, article_key) rows, as
    :func:`lorewell.operators.edges.rows_of` gives.  Candidates are few a query,
    so sources are looked up for them and never listed for a query.
    """
    sources = concepts.select("slug", "article_key") if "article_key" in concepts.columns else concepts.select("slug", F.explode("sources").alias("article_key"))
    asked = candidates.select("query_id", "article_key").distinct().join(hits.select("query_id", "slug"), "query_id")
    cited = asked.join(sources, ["slug", "article_key"], "left_semi").select("query_id", "article_key").distinct()
    return candidates.join(cited, ["query_id", "article_key"], "left_anti")


def retrieve(
    queries: DataFrame,
    keyword: DataFrame,
    vector: DataFrame | None,
    hits: DataFrame | None,
    concepts: DataFrame,
    mode: str = "hybrid",
    top_k: int = TOP_K,
    strict_exclude: bool = False,
) -> DataFrame:
    """What each query gets: its concepts first, then article blocks to fill ``top_k``.

    ``keyword`` and ``vector`` are ranked block lists, ``hits`` the ranked
    concepts (None where the wiki is not healthy).  Modes: keyword leaves out
    sources of the concepts, as every mode does without a vector list; vector
    too, and a query without vector results gets its keyword list; hybrid fuses the keyword list with the vector list
    that leaves them out.  Keyword lists of fallback and fusion leave sources
    out only with ``strict_exclude``.  Leaving out comes after the lists were cut,
    so places may stay empty.  Returns query_id, place, layer, name (slug or
    article_key), ordinal, block_type, mode (as resolved) and warning.
    """
    if mode not in ("keyword", "vector", "hybrid"):
        raise ValueError(f"no mode {mode}")
    without = lambda df: exclude_cited(df, hits, concepts) if hits is not None else df
    keyword_used = without(keyword) if strict_exclude else keyword
    if mode == "keyword" or vector is None:
        blocks = without(keyword).withColumn("mode", F.lit("keyword"))
    else:
        near = without(vector)
        served = near.select("query_id").distinct()
        main = near if mode == "vector" else rrf_fusion(keyword_used.join(served, "query_id", "left_semi"), near, limit=top_k)
        rest = keyword_used.join(served, "query_id", "left_anti")
        keys = ["query_id", "article_key", "ordinal", "block_type", "rank"]
        blocks = main.select(*keys).withColumn("mode", F.lit(mode)).unionByName(rest.select(*keys).withColumn("mode", F.lit("keyword")))
    columns = "query_id", "layer", "name", "ordinal", "block_type", "mode", "rank"
    rows = blocks.select(
        "query_id", F.lit(1).alias("layer"), F.col("article_key").alias("name"), "ordinal", "block_type", "mode", "rank"
    ).select(*columns)
    if hits is not None:
        first = hits.select(
            "query_id", F.lit(0).alias("layer"), F.col("slug").alias("name"), F.lit(0).alias("ordinal"),
            F.lit("wiki_concept").alias("block_type"), F.lit(None).cast("string").alias("mode"), "rank",
        )
        rows = first.select(*columns).unionByName(rows)
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy("layer", "rank"))
    rows = rows.withColumn("place", place).withColumn("mode", F.coalesce(F.max("mode").over(w), F.lit("keyword"))).where(F.col("place") <= top_k)
    fell = F.when((F.col("mode") != mode), F.lit(f"{mode} retrieval returned no results; fell back to keyword"))
    return rows.join(queries.select("query_id"), "query_id", "left_semi").select(
        "query_id", "place", F.when(F.col("layer") == 0, "concept").otherwise("article").alias("layer"), "name", "ordinal", "block_type",
        "mode", fell.alias("warning"),
    )


# How blocks of the wiki are named in a context.
CONTEXT_LABELS = {"wiki_concept": "Wiki Concept", "wiki_source": "Wiki Source Summary"}


def format_context(retrieved: DataFrame) -> DataFrame:
    """(query_id, context) of ``retrieved(query_id, place, title, path, content_type, block_type, text)``: numbered blocks."""
    label = F.lit("Article")
    for kind, name in CONTEXT_LABELS.items():
        label = F.when(F.col("block_type") == kind, name).otherwise(label)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    chunk = F.concat_ws(
        "\n",
        F.format_string("[Context %d] [%s]", "place", label),
        F.concat(F.lit("Title: "), text("title")),
        F.concat(F.lit("Path: "), text("path")),
        F.concat(F.lit("Content Type: "), text("content_type")),
        F.concat(F.lit("Block Type: "), text("block_type")),
        F.concat(F.lit("Content: "), text("text")),
    )
    parts = F.array_sort(F.collect_list(F.struct("place", chunk.alias("chunk"))))  # at most top_k a query
    return retrieved.groupBy("query_id").agg(F.array_join(parts["chunk"], "\n\n").alias("context"))
