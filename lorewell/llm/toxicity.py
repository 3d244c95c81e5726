"""Toxicity scores by non-negative positive-unlabelled learning.

Training takes a bounded sample: at most ``max_positive`` confirmed toxic
documents and ``max_unlabelled`` documents of unknown class, both chosen by a
hash of their id.  A word (after lower-casing A-Z) is a feature if its share of
documents differs clearly between the two.  Logistic classifiers over these
features minimise the non-negative risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

whose second term corrects the unlabelled documents' risk for the toxic ones
among them.  Every document is then scored on its whole text by the mean of the
classifiers; only words count, each once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common, kernel

_U = np.uint64


def _distinct_words(column):
    data, offsets = kernel.utf8(column)
    for a, b in kernel.passes(offsets):
        w = kernel.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kernel.ALNUM, lower=True)
        yield a, b, w.hashes(), w.owner()


def _features(batches):
    for batch in batches:
        for a, b, words, owner in _distinct_words(batch["_t"]):
            words, owner = kernel.distinct_per_owner(words, owner)
            yield pa.RecordBatch.from_arrays(
                [batch["_id"].slice(a, b - a), batch["positive"].slice(a, b - a),
                 kernel.lists(words.view(np.int64), owner, b - a)],
                ["_id", "positive", "words"],
            )


class Sparse:
    """Binary rows: row and column of each feature that a document has."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, width: int):
        self.rows, self.cols, self.n, self.width = rows, cols, n, width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.width)


def fit(
    positive: Sparse, unlabelled: Sparse, prior: float, rounds: int = 1500, rate: float = 0.05, decay: float = 1e-5
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam steps.

    While the corrected term is below zero the step goes up its own gradient
    and leaves the rest alone, as the estimator's authors propose.
    """
    k = positive.width
    w = np.zeros(k + 1)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)
    for step in range(1, rounds + 1):
        zp, zu = positive.times(w[:k]) + w[k], unlabelled.times(w[:k]) + w[k]
        negative = soft(zu).mean() - prior * soft(zp).mean()
        up, gp_neg, gu = -sig(-zp) / positive.n, sig(zp) / positive.n, sig(zu) / unlabelled.n
        if negative >= 0:
            gp, gu = prior * up - prior * gp_neg, gu
        else:
            gp, gu = prior * gp_neg, -gu
        g = np.append(positive.back(gp) + unlabelled.back(gu) + decay * w[:k], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:k], float(w[k])


class Model:
    """Word hashes (sorted) with a weight for each classifier, and the biases."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.words, self.weights, self.bias = words, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(words >> _U(44)).astype(np.int64)] = True

    def scores(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        hit = np.flatnonzero(self.maybe[(hashes >> _U(44)).astype(np.int64)])
        z = np.tile(self.bias, (n, 1))
        if len(hit) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes[hit]), len(self.words) - 1)
            real = self.words[at] == hashes[hit]
            pair = np.unique(owner[hit][real] * len(self.words) + at[real])  # each word once a document
            row, col = pair // len(self.words), pair % len(self.words)
            for c in range(z.shape[1]):
                z[:, c] += np.bincount(row, self.weights[col, c], n)
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).mean(1)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = 6000,
    max_unlabelled: int = 18000,
    min_z: float = 4.0,
    max_features: int = 5000,
    classifiers: int = 3,
) -> Model:
    """Train on the documents given and the labels given; a hold-out is the caller's.

    The class prior is the share of toxic rows among the labels.  Without any
    toxic example the model scores every document 0 (but for rounding).
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).alias("y")
    )
    n, n_pos = known.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    empty = Model(np.zeros(0, _U), np.zeros((0, 1)), np.full(1, -40.0))
    if not n_pos:
        return empty
    prior = min(0.9, n_pos / n)
    ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("n"))
    chosen = F.xxhash64("_id")
    positive = known.where("y = 1").select("_id").join(ids, "_id").orderBy(chosen, "_id").limit(max_positive).select("_id", "n")
    unlabelled = ids.orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(max_unlabelled)
    sample = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .join(F.broadcast(sample), "_id")  # at most max_positive + max_unlabelled ids
        .groupBy("_id", "positive")
        .agg(F.min("_t").alias("_t"))  # of rows of one id one, so that rows are bounded too
    )
    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.saved(
        rows.mapInArrow(_features, f"_id {kind}, positive boolean, words array<long>"), "toxicity-sample"
    )
    sizes = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    p, u = sizes.get(True, 0), sizes.get(False, 0)
    if not p or not u:
        return empty
    each = rows.select("positive", F.explode("words").alias("word"))
    share = each.groupBy("word").agg(
        F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b")
    )
    pool = (F.col("a") + F.col("b")) / (p + u)
    z = (F.col("a") / p - F.col("b") / u) / F.sqrt(pool * (1 - pool) * (1 / p + 1 / u))
    picked = (
        share.where((F.col("a") + F.col("b") >= 5) & (pool < 1))
        .withColumn("z", F.abs(z))
        .where(F.col("z") >= min_z)
        .orderBy(F.desc("z"), "word")
        .limit(max_features)
        .select("word")
    )
    words = np.sort(np.array([r["word"] for r in picked.collect()], np.int64).view(_U))
    if not len(words):
        return empty
    lists = rows.select("positive", F.array_intersect("words", F.lit(words.view(np.int64).tolist())).alias("w"))
    found = {True: [], False: []}
    for r in lists.collect():
        found[r["positive"]].append(np.searchsorted(words, np.array(r["w"], np.int64).view(_U)))

    def matrix(rows_: list[np.ndarray]) -> Sparse:
        at = np.repeat(np.arange(len(rows_)), [len(x) for x in rows_])
        return Sparse(at, np.concatenate(rows_).astype(np.int64), len(rows_), len(words))

    weights, bias = [], []
    rng = np.random.default_rng(7)
    for _ in range(classifiers):  # each leaves out some documents of both kinds
        part = [[x for x in found[k] if rng.random() < 0.8] or found[k] for k in (True, False)]
        w, b = fit(matrix(part[0]), matrix(part[1]), prior)
        weights.append(w)
        bias.append(b)
    return Model(words, np.stack(weights, 1), np.array(bias))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column ``out_col`` (0 to 1), which must not be one of its columns.

    Null and empty texts have the score of a text without features, by which
    documents without a known word are ranked alike (ties).  Repeated rows get
    equal scores.
    """
    if out_col in docs.columns:
        raise ValueError(f"documents have a column {out_col}; name another by out_col")

    def run(batches):
        for batch in batches:
            out = [
                model.scores(words, owner, b - a) for a, b, words, owner in _distinct_words(batch[text_col])
            ] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, out_col]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{out_col}` double")


def held_out(id_col) -> F.Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return common.crc32_of_id(id_col) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Train outside the held-out fold and score every document.

    Returns ``id_col``, held_out, score and predicted (1 from a score of 0.7).
    A null id is in no fold.  Empty tables give an empty result.
    """
    rest = ~F.coalesce(held_out(F.col(id_col)), F.lit(False))
    model = train(docs.where(rest), labels.where(rest), id_col, text_col, **limits)
    scored = score(docs.select(id_col, text_col), model, id_col, text_col)
    return scored.select(
        id_col,
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
