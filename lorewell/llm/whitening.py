"""Whitening of embeddings by the leading eigenvectors of their covariance.

Entries become integers, so sums and products over all different vectors are
exact: tasks add up products of vectors that were centred by a whole-number
mean, Spark adds the tasks' sums as decimals, and the remaining shift is taken
off exactly.  Only these d x d sums reach the driver, whatever the rows.

The eigenvectors come from a float32 solve and are then corrected by
multiplications of matrices in the widest floating type (:func:`refined`):
with R = I - X'X and S = X'VX, each pair of well-parted eigenvalues gets its
correction from S and R, which squares the error each time.  Where eigenvalues
cluster closer than the error allows, the correction only makes the vectors
orthonormal; V, shifted by the cluster's mean, is then projected on the
cluster, solved as a small problem of its own (by the same function), and the
vectors are turned by its solution.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common

#: Entries beyond this as integers are held there; a double has no unit place above it.
LARGEST = 1 << 53
#: The widest floating type that numpy has.
WIDE = np.longdouble
#: Sums of whole numbers below this are exact in doubles.
_EXACT = 1 << 53
#: Corrections in a row at most; each squares the error, so four or so are usual.
ROUNDS = 12
#: Times that clusters are solved and corrections go on, at most.
TURNS = 6


def whole(embedding: Column, scale: int = 256) -> Column:
    """Entries as long integers: floor of scale times the entry."""
    def entry(c: Column) -> Column:
        x = F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(0)
        return F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).cast("long")

    return F.transform(embedding, entry)


def _usable(embedding: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad, F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _summed(d: int):
    """Sums of every dimension over a task's vectors, and their number."""

    def run(batches):
        total, n = np.zeros(d, object), 0
        for batch in batches:
            x = _matrix(batch["x"], d)
            n += len(x)
            step = max(1, (1 << 62) // max(1, int(np.abs(x).max(initial=0))))
            for a in range(0, len(x), step):
                total += x[a : a + step].sum(0)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"k": pa.array(range(-1, d), pa.int32()), "v": pa.array([Decimal(int(v)) for v in [n, *total]], pa.decimal128(38, 0))}
            )

    return run


def products(y: np.ndarray) -> np.ndarray:
    """y'y of a matrix of whole numbers, exactly, as Python integers."""
    top = int(np.abs(y).max(initial=0))
    if top * top >= _EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    out = np.zeros((y.shape[1], y.shape[1]), object)
    step = max(1, _EXACT // max(1, top * top))
    for a in range(0, len(y), step):
        part = y[a : a + step].astype(float)
        out += (part.T @ part).astype(np.int64)  # whole numbers below 2**53
    return out


def _spread(d: int, centre: np.ndarray):
    """Sums of products of a task's centred vectors, for the upper triangle, row by row, and sums of the vectors."""

    def run(batches):
        total, once, seen = np.zeros((d, d), object), np.zeros(d, object), False
        for batch in batches:
            y = _matrix(batch["x"], d) - centre
            total += products(y)
            once += y.astype(object).sum(0) if len(y) > 256 and np.abs(y).max() > 1 << 44 else y.sum(0)
            seen = True
        if seen:
            values = [*total[np.triu_indices(d)], *once]
            yield pa.RecordBatch.from_pydict(
                {"k": pa.array(range(len(values)), pa.int32()), "v": pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))}
            )

    return run


def _total(parts: DataFrame) -> dict[int, int]:
    """Sums by key over all tasks; there are as many keys as a matrix has entries."""
    return {r.k: int(r.v) for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect()}


def _norm(m: np.ndarray):
    return np.sqrt((m * m).sum())


def _corrected(b: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """(vectors after one correction, eigenvalues, groups of places that cluster, size of the correction).

    Gaps that the present error can't tell from nothing, or below ``least``, make a cluster.
    """
    d = len(b)
    r = np.eye(d, dtype=b.dtype) - x.T @ x
    s = x.T @ (b @ x)
    lam = np.diag(s) / (1 - np.diag(r))
    near = max(2 * (_norm(s - np.diag(lam)) + _norm(b) * _norm(r)), least)
    gap = lam[None, :] - lam[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(lam, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(lam[order]) > near) + 1)
    return x + x @ e, lam, [g for g in groups if len(g) > 1], float(np.abs(e).max())


def _settled(b: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Corrections until they get no smaller: (vectors, eigenvalues, clusters)."""
    before = np.inf
    for _ in range(ROUNDS):
        x, lam, clusters, change = _corrected(b, x, least)
        if change <= 4 * len(b) * np.finfo(b.dtype).eps or change > before / 2:
            break
        before = change
    return x, lam, clusters


def refined(a: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a symmetric matrix, from a float32 solve by corrections in ``a``'s type.

    The matrix (d x d, in memory) is shifted by its mean eigenvalue first, so that its parts are
    as far from each other as its size.  Gaps below ``floor`` (what rounding of
    the outermost matrix can make) are none: any basis of such a space is right.
    """
    d = len(a)
    if floor is None:
        floor = 8 * d * np.finfo(a.dtype).eps * _norm(a)
    b = a - np.eye(d, dtype=a.dtype) * (np.trace(a) / max(d, 1))
    size = _norm(b)
    x = np.eye(d, dtype=a.dtype)
    if d > 1 and size > floor:
        b, least = b / size, floor / size
        x = np.linalg.eigh(b.astype(np.float32))[1].astype(a.dtype)
        for _ in range(TURNS):
            x, lam, clusters = _settled(b, x, least)
            turned = False
            for places in clusters:
                part = x[:, places]
                sub = part.T @ (b @ part - lam[places].mean() * part)
                sub = (sub + sub.T) / 2
                if _norm(sub - np.diag(np.diag(sub))) > least and len(places) < d:
                    x[:, places] = part @ refined(sub, least)[1]
                    turned = True
            if not turned:
                break
        for _ in range(4):  # orthonormal also where gaps were near the floor
            x = x + x @ (np.eye(d, dtype=a.dtype) - x.T @ x) / 2
    lam = (x * (a @ x)).sum(0)
    order = np.argsort(-lam, kind="stable")
    return lam[order], x[:, order]


class Whitener:
    """What turns vectors into whitened components."""

    def __init__(self, n: int, sums: list[int], eigenvalues, vectors, trace):
        self.n, self.sums, self.trace = n, sums, float(trace)
        self.eigenvalues = np.asarray(eigenvalues, float)
        self.vectors = np.asarray(vectors, float)  # a column for each component
        self.centre = [(2 * s + n) // (2 * n) for s in sums]  # the mean, to a whole number
        self.shift = np.array([(s - n * c) / n for s, c in zip(sums, self.centre)])  # and the rest of it
        self.scaled = self.vectors / np.sqrt(self.eigenvalues)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of whole numbers."""
        y = (x - np.array(self.centre, np.int64)).astype(float) - self.shift
        return y @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared, exactly; null where a long can't hold it."""
        n, squares, mixed = self.n, [], []
        top = int(np.abs(x).max(initial=0))
        if top * top * x.shape[1] < 1 << 63 and top * sum(map(abs, self.sums)) < 1 << 63:
            squares = (x * x).sum(1).tolist()
            mixed = (x @ np.array(self.sums, np.int64)).tolist()
        else:
            wide = x.astype(object)
            squares, mixed = (wide * wide).sum(1).tolist(), (wide @ np.array(self.sums, object)).tolist()
        of_sums = sum(s * s for s in self.sums)
        out = [n * n * a - 2 * n * b + of_sums for a, b in zip(squares, mixed)]
        return [v if v < 1 << 63 else None for v in out]


def fit(distinct: DataFrame, d: int, components: int = 4) -> Whitener | None:
    """The whitener of ``distinct(x)``, in which every vector stands once; None if there is none or they don't vary.

    Components whose eigenvalue rounding alone could make are left out.
    """
    sums = _total(distinct.select("x").mapInArrow(_summed(d), "k int, v decimal(38,0)"))
    n = sums.get(-1, 0)
    if n < 2:
        return None
    s = [sums[k] for k in range(d)]
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    got = _total(distinct.select("x").mapInArrow(_spread(d, centre), "k int, v decimal(38,0)"))
    upper = d * (d + 1) // 2
    once = np.array([got[upper + k] for k in range(d)], object)
    whole_cov = np.zeros((d, d), object)  # n squared times the covariance, exactly
    rows, cols = np.triu_indices(d)
    for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist())):
        whole_cov[i, j] = whole_cov[j, i] = n * got[k] - once[i] * once[j]
    trace = sum(whole_cov[k, k] for k in range(d))
    if trace == 0:
        return None
    cov = np.array([[_wide(v) for v in row] for row in whole_cov.tolist()], WIDE).reshape(d, d) / (WIDE(n) * WIDE(n))
    lam, vec = refined(cov)
    total = _wide(trace) / (WIDE(n) * WIDE(n))
    k = int((lam[:components] > 1e-13 * total).sum())
    vec = vec[:, :k]
    sign = np.where(vec[np.abs(vec).argmax(0), np.arange(k)] < 0, -1, 1)  # the largest entry is positive
    return Whitener(n, s, lam[:k], vec * sign, total)


def _wide(v: int):
    """A whole number in the widest type; Python's own conversion would pass through a double."""
    out, high = WIDE(0), abs(v)
    for place in range(0, max(1, high.bit_length()), 32):
        out += WIDE((high >> place) & 0xFFFFFFFF) * WIDE(2) ** place
    return -out if v < 0 else out


def _moments(w: Whitener, d: int):
    """Sums of a task's whitened vectors and of their products; they are centred already."""

    def run(batches):
        k = len(w.eigenvalues)
        once, twice = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = w.project(_matrix(batch["x"], d))
            once += z.sum(0)
            twice += z.T @ z
        values = [*once, *twice.ravel()]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(values)), pa.int32()), "v": pa.array(values, pa.float64())})

    return run


def identity_error(distinct: DataFrame, w: Whitener, d: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    parts = distinct.select("x").mapInArrow(_moments(w, d), "k int, v double")
    got = {r.k: r.v for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    k = len(w.eigenvalues)
    mean = np.array([got[i] for i in range(k)]) / w.n
    cov = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / w.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def _applied(w: Whitener, d: int, error: float):
    def run(batches):
        k = len(w.eigenvalues)
        for batch in batches:
            x = _matrix(batch["x"], d)
            n = len(x)
            rows = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_id"].take(rows),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, w.n)),
                    pa.array(w.deviations(x), pa.int64()).take(rows),
                    pa.array(w.project(x).ravel()),
                    pa.array(np.tile(w.eigenvalues / w.trace, n)),
                    pa.array(np.full(n * k, error)),
                ],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(
    embeddings: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Whitened leading components of every usable vector.

    Vectors that are null or have null or non-finite entries are dropped, and so
    are those of another length than most (of equally common lengths the greater
    counts) and empty ones.  Entries become whole numbers x (:func:`whole`; held
    to 2**53).  The model is fitted on every different x once, and applied to
    all rows, copies and rows of one id too.

    Returns per row and component (``components`` at most, fewer if the vectors
    vary in fewer directions) ``id_col``, component, n (different vectors),
    deviation (null beyond a long), whitened, explained and identity_error.
    Fewer than two different vectors, or none, give an empty result; other
    columns are ignored.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where(_usable(F.col("_v")))
    rows = rows.select("_id", whole(F.col("_v"), scale).alias("x"))
    common_size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common_size.d if common_size else 0
    none = rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    if not d:
        return none
    rows = rows.where(F.size("x") == d)
    distinct = common.saved(rows.select("x").distinct(), "fit-list")
    w = fit(distinct, d, components)
    if w is None or not len(w.eigenvalues):
        return none
    error = identity_error(distinct, w, d)
    return rows.mapInArrow(_applied(w, d, error), schema).withColumnRenamed("_id", id_col)
