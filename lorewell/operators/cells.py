"""An index of vectors by cells, with which exact neighbours are found without comparing every pair.

Vectors are put at length 1 and into the cell of the nearest of some centres,
which come from a bounded sample; every vector is in a cell, with its distance
from the centre.  A search looks into each query's nearest cells first.  The
n-th best score found there is a limit: by the triangle inequality a vector is
at least as far from the query as the query's and the vector's distances from
the centre differ, so whole cells, and vectors within cells, whose bound is
below the limit are not compared.  What is left out can't be among the best n,
so the result equals that of comparing all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators import retrieval as R
from lorewell.sources import scratch

#: Vectors that centres are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8
#: Cells of a query that are searched first.
PROBED = 2
#: What rounding can do to a bound on a score.
SLACK = 2e-6
_ROW = "id long, embedding array<float>, cell int, gap double"


def fit_centres(index: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres at length 1 of about that many cells, from ``sample`` vectors of ``index(id, embedding)`` chosen by a hash of their id.

    Vectors of the most common length count; without vectors there is no centre.
    """
    usable = index.where("embedding IS NOT NULL AND size(embedding) > 0")
    most = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return np.zeros((0, 0))
    rows = usable.where(F.size("embedding") == most.d).orderBy(F.xxhash64("id"), "id").select("embedding").limit(sample).collect()
    x = R.unit_rows(np.array([r.embedding for r in rows], np.float64))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres = R.unit_rows(np.where(filled[:, None], sums, centres))
    return np.unique(centres, axis=0)


def _distance(cos: np.ndarray) -> np.ndarray:
    """Distance of vectors of length 1 from their cosine."""
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def into_cells(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, embedding, cell, gap) of every vector that has the centres' length; zero vectors are in a cell too, at distance 1 or so."""
    shared = index.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value
        for batch in batches:
            x = R.vectors_of(batch)
            cos = x @ c.T
            cell = cos.argmax(1)
            # of a vector that is no longer than 0 the distance is the centre's length
            square = (x * x).sum(1) + 1 - 2 * cos[np.arange(len(x)), cell]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["embedding"], pa.array(cell.astype(np.int32)), pa.array(np.sqrt(np.maximum(square, 0)))],
                ["id", "embedding", "cell", "gap"],
            )

    fits = index.where(F.size("embedding") == (centres.shape[1] or -1))
    return fits.select("id", "embedding").mapInArrow(run, _ROW)


def write_cells(index: DataFrame, path: str, cells: int, sample: int = SAMPLE) -> None:
    """Fit centres and write all vectors in the order of cell and distance, so that files and row groups hold few cells.

    A cell with very many vectors is parted by distance over several files.
    """
    spark = index.sparkSession
    centres = fit_centres(index, cells, sample)
    rows = scratch.kept(into_cells(index, centres))
    rows.repartitionByRange(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "cell", "gap").sortWithinPartitions("cell", "gap").write.parquet(f"{path}/rows")
    sizes = {r.cell: r for r in rows.groupBy("cell").agg(F.min("gap").alias("low"), F.max("gap").alias("high")).collect()}
    said = [(k, c.tolist(), sizes[k].low if k in sizes else 1e9, sizes[k].high if k in sizes else -1.0) for k, c in enumerate(centres)]
    spark.createDataFrame(said, "cell int, centre array<double>, low double, high double").coalesce(1).write.parquet(f"{path}/centres")


class _Cells:
    """Centres, and the distances of each cell's vectors from its centre."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.cell)
        self.centres = np.array([r.centre for r in rows]) if rows else np.zeros((0, 1))
        self.low, self.high = np.array([r.low for r in rows]), np.array([r.high for r in rows])

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance of each query from each centre, best score that a cell can hold for it)."""
        away = _distance(unit @ self.centres.T)
        return away, best_score(away, self.low, self.high)


def best_score(away: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest score of a vector whose distance from a centre is between low and high, for a query ``away`` from it."""
    nearest = np.maximum(np.maximum(away - high, low - away), 0)
    return np.maximum(1 - nearest * nearest / 2, 0)


def _search(shared, n: int):
    """Best n of a task's rows; each query is compared with rows of cells that it asks for, down to its limit."""

    def run(batches):
        ids, unit, away, asked, limit = shared.value
        best = R.BestVectors(len(ids), n)
        done = 0
        for batch in batches:
            cell = batch["cell"].to_numpy()
            gap = batch["gap"].to_numpy()
            edges = np.flatnonzero(np.diff(cell, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(cell)]):
                for t in range(a, b, R.VECTOR_TILE):
                    part = batch.slice(t, min(R.VECTOR_TILE, b - t))
                    low, high = gap[t : t + part.num_rows].min(), gap[t : t + part.num_rows].max()
                    worst = np.maximum(limit, best.score[:, -1])
                    places = np.flatnonzero(asked[:, cell[a]] & (best_score(away[:, cell[a]], low, high) + SLACK >= worst))
                    x, at = R.vectors_of(part), part["id"].to_numpy()
                    for q in range(0, len(places), R.QUERY_TILE):
                        mine = places[q : q + R.QUERY_TILE]
                        best.add(mine, R.cosines(unit[mine], x), at)
                        done += len(mine) * part.num_rows
        out = best.rows(ids)
        counted = pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([done]), pa.array([0.0])], ["query_id", "id", "score"])
        yield out
        yield counted

    return run


def search(spark, path: str, queries: DataFrame, n: int, probed: int = PROBED, count: bool = False):
    """(query_id, id, score, rank): the ``n`` nearest by cosine similarity, exactly, of the index at ``path``.

    As :func:`lorewell.operators.retrieval.vector_scores`, but read from cells.
    Queries of another length than the index's vectors match nothing.  With
    ``count``, also the number of pairs of a query and a vector that were compared.
    """
    cells = _Cells(spark.read.parquet(f"{path}/centres").collect())  # as many as there are cells
    rows = spark.read.parquet(f"{path}/rows")
    schema = "query_id long, id long, score double"
    found, compared = spark.createDataFrame([], schema), 0
    d = cells.centres.shape[1]
    asked = queries.where(F.size("embedding") == d).select("query_id", "embedding") if len(cells.centres) else queries.limit(0)
    for block in R._query_blocks(asked):
        if not block:
            continue
        ids, unit = R.unit_queries(block)
        zero = ~(unit * unit).sum(1).astype(bool)  # nothing is near or far for these
        away, bound = cells.bounds(unit)
        first = np.zeros(bound.shape, bool)
        order = np.lexsort((away, -bound), axis=1)[:, :probed]
        np.put_along_axis(first, order, True, 1)
        first[zero] = True

        def run(which: np.ndarray, limit: np.ndarray) -> DataFrame:
            there = np.flatnonzero(which.any(0)).tolist()
            shared = spark.sparkContext.broadcast((ids, unit, away, which, limit))  # noqa: B023
            some = rows.where(F.col("cell").isin(there)) if there else rows.limit(0)
            return scratch.kept(some.mapInArrow(_search(shared, n), schema))

        open_ = np.full(len(ids), -1.0)
        open_[zero] = -np.inf
        near = run(first, open_)
        limit = np.full(len(ids), -1.0)
        best = R.nearest_of(near.where("query_id IS NOT NULL"), n).where(F.col("rank") == n)
        place = {q: k for k, q in enumerate(ids.tolist())}
        for r in best.select("query_id", "score").collect():  # one row a query of the block
            limit[place[r.query_id]] = r.score
        rest = ~first & (bound + SLACK >= limit[:, None])
        parts = near.unionByName(run(rest, limit)) if rest.any() else near
        if count:
            compared += parts.where("query_id IS NULL").agg(F.sum("id")).first()[0] or 0
        found = found.unionByName(parts.where("query_id IS NOT NULL"))
    out = R.nearest_of(found, n)
    return (out, compared) if count else out
