"""Quality classifier by positive-unlabelled learning.

A linear scorer over character-class and word statistics of whole texts is
trained to minimise the non-negative unbiased PU risk (Kiryo et al., 2017) from
trusted positives and unlabelled text; negatives are never shown to it.  The
class prior is estimated from the same two samples as the smallest ratio of
unlabelled to positive mass over score regions (Scott, 2015).

The fit reads bounded samples (`positives`, `unlabelled` rows); scoring is one
pass over all rows without a shuffle.

Defined cases: a null or empty text is scored like any other, from its all-zero
statistics; rows are independent, so repeated rows get equal scores; without any
trusted positive or unlabelled row every score is 0.5; labels of ids that have
no document are ignored; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, slices
from .samples import held_out, learnable, sample

# Characters that have a class of their own; others share one by kind.
MARKS = b"!|%$&*#?.,;:-'<{=@"
CLASSES = 9 + len(MARKS)
_CLASS = np.full(256, 8, dtype=np.int64)
_CLASS[97:123] = 0
_CLASS[:32] = 5
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[128:192] = 6
_CLASS[192:] = 7
for _k, _b in enumerate(MARKS):
    _CLASS[_b] = 9 + _k
STATS = 6
WIDTH = CLASSES * CLASSES + STATS


def features(column: pa.Array) -> np.ndarray:
    """Square roots of the rates of class pairs, then word statistics, for each text."""
    words = Words(column)
    data, offsets = words.data, words.offsets
    rows, n = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, WIDTH), dtype=np.float32)
    if len(data) > 1:
        kind = _CLASS[data]
        owner = np.repeat(np.arange(rows), n)
        inner = owner[1:] == owner[:-1]
        key = owner[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
        counts = np.bincount(key[inner], minlength=rows * CLASSES * CLASSES).reshape(rows, -1)
        out[:, :-STATS] = np.sqrt(counts / np.maximum(n - 1, 1)[:, None])
    count = np.maximum(words.counts, 1)
    row, names = words.row, words.hashes()
    lengths = words.ends - words.starts
    mean = np.bincount(row, weights=lengths, minlength=rows) / count
    distinct = np.unique((row.astype(U64) << U64(44)) | (names >> U64(20))) >> U64(44)
    unique = np.bincount(distinct.astype(np.int64), minlength=rows) / count
    same = [np.bincount(row[k:][(names[k:] == names[:-k]) & (row[k:] == row[:-k])], minlength=rows) / count if len(names) > k else np.zeros(rows) for k in (1, 2)]
    out[:, -STATS:] = np.stack([np.log1p(words.counts) / 10, np.minimum(mean, 40) / 10, unique, same[0], same[1], np.bincount(row, weights=lengths > 25, minlength=rows) / count], axis=1)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, width: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros((3, width), dtype=np.float32)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """Share of positives among unlabelled rows: the smallest ratio of masses above a score, over regions with `least` of the positives."""
    best = 1.0
    for cut in np.quantile(positive, np.linspace(0, 1 - least, 40)):
        best = min(best, (unlabelled >= cut).mean() / max((positive >= cut).mean(), 1e-9))
    return float(np.clip(best, 0.05, 0.99))


def fit_pu(p: np.ndarray, u: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> QualityModel:
    """Minimise the non-negative PU risk with the logistic loss of a linear scorer."""
    mean, scale = u.mean(axis=0), u.std(axis=0) + np.float32(0.02)
    p1, u1 = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1), dtype=x.dtype)]) for x in (p, u))
    # the prior, from scores of rows that the scorer hasn't seen
    halves, pp, uu = [np.arange(2) == k for k in (0, 1)], [], []
    for half in halves:
        a, b = p1[np.resize(half, len(p1))], u1[np.resize(half, len(u1))]
        w = _adam(lambda w: -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + 0.01 * w, p1.shape[1], 120, rate)
        pp.append(p1[~np.resize(half, len(p1))] @ w)
        uu.append(u1[~np.resize(half, len(u1))] @ w)
    prior = class_prior(np.concatenate(pp), np.concatenate(uu))

    def grad(w: np.ndarray) -> np.ndarray:
        gp, gu = p1 @ w, u1 @ w
        sp, su = _sigmoid(gp), _sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_positive = -prior * (p1.T @ (1 - sp)) / len(p1)
        of_negative = u1.T @ su / len(u1) - prior * (p1.T @ sp) / len(p1)
        return (of_positive + of_negative if negative >= 0 else -of_negative) + decay * w

    w = _adam(grad, p1.shape[1], steps, rate)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", positives: int = 2500, unlabelled: int = 2500) -> QualityModel | None:
    """Fit on at most `positives` trusted rows (label 1, not held out) and `unlabelled` rows that have no label and aren't held out (if all are labelled: any that aren't held out)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select("doc_id", label)
    ids = base.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    p_ids = sample(learnable(known, label).where("y = 1").select("doc_id").join(ids.distinct(), "doc_id", "left_semi"), positives)
    free = ids.join(known.select("doc_id"), "doc_id", "left_anti")
    if free.isEmpty():
        free = ids
    chosen = sample(free.distinct(), unlabelled).select("doc_id", F.lit(False).alias("p")).unionByName(p_ids.select("doc_id", F.lit(True).alias("p")))
    rows = base.join(F.broadcast(chosen), "doc_id").select("p", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column(1))
            yield pa.RecordBatch.from_pydict({"p": batch.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.mapInArrow(run, "p boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), dtype=np.float32).reshape(-1, WIDTH)
    x = x[order := np.lexsort(x[:, ::-1].T[-8:])] if len(x) else x  # the fit doesn't depend on the order in which tasks end
    p = np.array(got["p"].to_pylist(), dtype=bool)[order] if len(x) else np.zeros(0, dtype=bool)
    if p.sum() < 2 or (~p).sum() < 2:
        return None
    mixed = np.random.default_rng(0).permutation(len(x))
    return fit_pu(x[mixed][p[mixed]], x[mixed][~p[mixed]])


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row, in one pass."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            s = m.score(features(batch.column(1))) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(s, pa.float64())})

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
