"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Each view learns from the labelled rows; then, over rounds, each gives the other the pool's documents that it is surest
of, as labels. Both are calibrated out of fold on true labels, and their log-odds are summed with weights fitted there. The pool and
the labelled rows are bounded samples; every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import trees
from palimpsest.llm import words as W
from palimpsest.llm.labelled import held_out, sample
from palimpsest.llm.shared import Shipped, stash

SCORES = "doc_id long, held_out boolean, text_score double, meta_score double, score double, predicted int, kept boolean"
#: Buckets that sources and languages are hashed to.
BUCKETS = 64

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of kinds of characters, of distinct words, pairs and lines, and sizes of words and lines."""
    s, e, wo = W.spans(data, off, W.NON_SPACE)
    h, row = W.hashes(data, s, e), W.row_of(wo)
    n, size = np.maximum(np.diff(wo), 1), np.maximum(np.diff(off), 1)

    def distinct(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, r))
        new = np.ones(len(x), bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (r[order][1:] != r[order][:-1])
        return np.bincount(r[order][new], minlength=len(n)).astype(float)

    pairs = W.ngrams(h, 2)
    ok = W.within_rows(wo, 2, len(h))
    line = np.ones(256, bool)
    line[10] = False
    ls, le, lo = W.spans(data, off, line)
    lines = np.maximum(np.diff(lo), 1)
    signs = W.counts(_SIGN[data])
    ends = (signs[e] - signs[s] >= 2) & (e > s)
    alone = (signs[e] - signs[s]) == e - s
    upper = W.counts(_UPPER[data])
    caps = (upper[e] - upper[s] >= 2) & (upper[e] - upper[s] >= (e - s) / 2)
    cols = [np.log1p(np.diff(wo)), W.sums(_UPPER[data], off) / size, W.sums(_DIGIT[data], off) / size, W.sums(_SIGN[data], off) / size, W.sums(data >= 128, off) / size]
    cols += [distinct(h, row) / n, distinct(pairs[ok], row[: len(pairs)][ok]) / n, distinct(W.hashes(data, ls, le), W.row_of(lo)) / lines]
    cols += [np.diff(off) / n, np.log1p(np.diff(lo)), n / lines, W.sums(ends, wo) / n, W.sums(alone, wo) / n, W.sums(caps, wo) / n]
    return np.stack(cols, axis=1)


def _bucket(column: pa.Array) -> np.ndarray:
    data, off = W.buffers(column.cast(pa.string()))
    return (W.hashes(data, off[:-1], off[1:]) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def _meta(batch: pa.RecordBatch) -> np.ndarray:
    """Buckets of source and language (0: null) and the stated length (-1: null)."""
    cols = []
    for name in ("source", "lang"):
        c = batch.column(batch.schema.get_field_index(name))
        cols.append(np.where(c.is_null().to_numpy(zero_copy_only=False), 0, _bucket(c)).astype(float))
    n = batch.column(batch.schema.get_field_index("n_chars")).to_numpy(zero_copy_only=False).astype(float)
    cols.append(np.where(np.isnan(n), -1.0, n))
    return np.stack(cols, axis=1)


class Metadata:
    """Trees over smoothed label rates of the buckets, and the stated length."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rates = []
        mean = y.mean() if len(y) else 0.5
        for j in (0, 1):
            k = x[:, j].astype(np.int64)
            self.rates.append((np.bincount(k, y, BUCKETS) + 10 * mean) / (np.bincount(k, minlength=BUCKETS) + 10))
        self.model = trees.boost(self.coded(x), y, depth=2, trees=30)

    def coded(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.rates[0][x[:, 0].astype(np.int64)], self.rates[1][x[:, 1].astype(np.int64)], x[:, 2]], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.model.raw(self.coded(x))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _weights(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    a = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(3)
    for _ in range(rounds):
        p = trees.sigmoid(a @ w)
        w = w - np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.eye(3), a.T @ (p - y) + w)
    return w


class Model:
    def __init__(self, text, meta, calibrate, weights):
        self.text, self.meta, self.calibrate, self.weights = text, meta, calibrate, weights

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.calibrate[0](self.text.raw(xt)), self.calibrate[1](self.meta.raw(xm))
        return a, b, trees.sigmoid(np.stack([_logit(a), _logit(b), np.ones(len(a))], axis=1) @ self.weights)


def _taught(xt, xm, y, pool_t, pool_m, rounds: int, grow: float, sure: float) -> dict:
    """The models of both views after the rounds."""
    given = {"t": np.full(len(pool_t), np.nan), "m": np.full(len(pool_t), np.nan)}  # labels that a view has received
    mean = y.mean()
    fit = {}
    for r in range(rounds + 1):
        for v, x, pool in (("t", xt, pool_t), ("m", xm, pool_m)):
            got = ~np.isnan(given[v])
            a, b = np.concatenate([x, pool[got]]), np.concatenate([y, given[v][got]])
            fit[v] = trees.boost(a, b) if v == "t" else Metadata(a, b)
        if r == rounds or not len(pool_t):
            break
        for v, other, pool in (("t", "m", pool_t), ("m", "t", pool_m)):
            z = fit[v].raw(pool)
            p = trees.sigmoid(z)
            free = np.isnan(given[other])
            for label, conf, share in ((1.0, p, mean), (0.0, 1 - p, 1 - mean)):
                can = np.flatnonzero(free & (conf >= sure))
                take = can[np.argsort(-conf[can], kind="stable")[: max(1, int(grow * share * len(pool)))]]
                given[other][take] = label
    return fit


def cotrain(xt, xm, y, ids, pool_t, pool_m, *, rounds: int = 5, grow: float = 0.04, sure: float = 0.9) -> Model:
    """Each round each view labels, of the pool's rows it is at least `sure` of, at most a share `grow` of the pool, in the
    proportion of the labels' classes, for the other view. Calibration and weights are fitted to scores of models for which the
    whole co-training was repeated without the row's fold, so no pseudo-label has seen it either."""
    oof = [np.zeros(len(y)), np.zeros(len(y))]
    fold = trees.folds(ids)
    for k in range(5):
        if (mine := fold == k).any():
            fit = _taught(xt[~mine], xm[~mine], y[~mine], pool_t, pool_m, rounds, grow, sure) if (~mine).any() else None
            oof[0][mine], oof[1][mine] = (fit["t"].raw(xt[mine]), fit["m"].raw(xm[mine])) if fit else (0.0, 0.0)
    fit = _taught(xt, xm, y, pool_t, pool_m, rounds, grow, sure)
    calibrate = [trees.isotonic(z, y) for z in oof]
    z = np.stack([_logit(c(z)) for c, z in zip(calibrate, oof, strict=True)], axis=1)
    return Model(fit["t"], fit["m"], calibrate, _weights(z, y))


def _viewed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, off = W.buffers(batch.column(batch.schema.get_field_index("text")))
    parts = [text_features(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in W.slices(off)]
    return (np.concatenate(parts) if parts else np.zeros((0, 14))), _meta(batch)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, rows: int = 20_000, pool: int = 20_000, rounds: int = 5) -> DataFrame:
    """The calibrated score of each view, their combination, and predicted (1: good) for every document.

    At most `rows` labelled documents, none of them held out (crc32 of the id as text leaves 2 modulo 4), and a pool of at most
    `pool` others teach the views. A null or empty text has no words; null metadata is a value of its own; a null id is never
    learned from. Repeated documents score alike. Where the labels are missing or all alike, every score is their mean (1
    without any: nothing is thrown away unlearned). Other columns are not read.
    """
    spark = docs.sparkSession
    cols = ["text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars")]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *cols)
    chosen = sample(labels, "quality", rows)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().join(named, "doc_id", "left_anti")
    others = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool).withColumn("y", F.lit(-1))
    picked = stash(chosen.unionByName(others), "quality-ids")

    def view(batches):
        for batch in batches:
            t, m = _viewed(batch)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (t, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("y")), *lists], ["doc_id", "y", "t", "m"])

    got = base.join(F.broadcast(picked), "doc_id").mapInArrow(view, "doc_id long, y int, t array<double>, m array<double>").orderBy("doc_id", "t", "m").collect()
    t, m = np.array([r.t for r in got]).reshape(len(got), 14), np.array([r.m for r in got]).reshape(len(got), 3)
    y, ids = np.array([r.y for r in got], float), np.array([r.doc_id for r in got], np.int64)
    known = y >= 0
    if not known.any() or y[known].min() == y[known].max():
        model, flat = None, float(y[known].mean()) if known.any() else 1.0
    else:
        model, flat = cotrain(t[known], m[known], y[known], ids[known], t[~known], m[~known], rounds=rounds), 0.0
    shipped = Shipped(spark, model)

    def run(batches):
        for batch in batches:
            if shipped.value is None:
                a = b = c = np.full(batch.num_rows, flat)
            else:
                a, b, c = shipped.value.score(*_viewed(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in (a, b, c)), pa.array((c >= threshold).astype(np.int32)), pa.array(c >= threshold)], [x.split(" ")[0] for x in SCORES.split(", ")])

    return base.mapInArrow(run, SCORES)
