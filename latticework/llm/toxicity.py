"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-cased runs of letters, digits and bytes beyond ASCII: all that
occur in a bounded, stratified sample of labelled rows, the examples.  Their
document frequencies come from one pass over all documents.  A term's weight is
TF-IDF, times 1 + excess / CHI of its chi-square against the label over NOISE:
telling terms weigh more, and none is left out.

The examples' vectors form an inverted index in blocks.  A batch of texts adds
up the postings of rare terms first.  For terms that many examples hold, each
block keeps the largest weight; what that adds to a block's best sum bounds its
cosines, and blocks whose bound can't reach the k-th nearest of the most
promising ones are not multiplied out.  What is left is summed again in double
precision, so the neighbours are exact.  Votes are weighted by distance,
corrected for the sample's strata and calibrated on the examples themselves,
each left out in turn.

Defined cases: null, empty and term-free texts (no term in common with any example) have an empty vector, whose score
is the rate of toxic labels among examples with empty vectors; equal texts get
equal scores and evidence (ties: smaller example number); rows are independent,
those of a repeated or null id too; without labels of both kinds every score is
the base rate, or 0; extra columns are not read, and `keep_clean` returns them
as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SYMBOLS, U64, Words, mix, pack_by, ragged, sequence_hash, slices
from .samples import learnable, sample
from .spread import checkpoint

BLOCK = 64
NEIGHBOURS = 15
#: A term's weight grows with its chi-square beyond NOISE, doubling CHI further on.
CHI, NOISE = 30.0, 10.0
#: Terms in so large a share of the examples are bounded by block; texts that are searched at once.
COMMON, TEXTS = 1 / 48, 128
_DOOR = 22
#: Document frequencies are summed in parts of 2**_PART terms.
_PART = 13
#: Weight of the prior on the calibration's slope, in examples.
PULL = 20.0
#: What single precision may hide of a cosine.
SLACK = 1e-4


class Vocabulary:
    """Sorted term names, with a small door table that turns most other terms away."""

    def __init__(self, names: np.ndarray):
        self.names = np.sort(names)
        self._open()

    def __getstate__(self) -> np.ndarray:
        return self.names

    def __setstate__(self, names: np.ndarray) -> None:
        self.names = names
        self._open()

    def _open(self) -> None:
        self.door = np.zeros(1 << _DOOR, dtype=bool)
        self.door[(self.names >> U64(64 - _DOOR)).astype(np.int64)] = True

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, term numbers and counts of the terms that occur, by row and term."""
        words = Words(column, lower=True, breaks=SYMBOLS)
        if not len(self.names):
            return (np.zeros(0, dtype=np.int64),) * 3
        names = words.hashes()
        near = np.flatnonzero(self.door[(names >> U64(64 - _DOOR)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.names, names[near]), len(self.names) - 1)
        hit = self.names[k] == names[near]
        key, count = np.unique(words.row[near[hit]] * len(self.names) + k[hit], return_counts=True)
        return key // len(self.names), key % len(self.names), count


class BlockMaxIndex:
    """Vectors of examples, in blocks: postings of rare terms, and of common ones a panel with each block's largest weight."""

    def __init__(self, cut: np.ndarray, term: np.ndarray, weight: np.ndarray, width: int):
        """Example i has the terms term[cut[i] : cut[i + 1]], ascending, with their weights."""
        n = len(cut) - 1
        self.cut, self.term, self.weight, self.width = cut, term, weight, width
        # similar examples share blocks: by their heaviest terms
        heavy = [tuple(term[a:b][np.argsort(-weight[a:b], kind="stable")[:3]].tolist()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        self.members = np.array(sorted(range(n), key=lambda i: (heavy[i], i)), dtype=np.int64)
        self.blocks = max(1, -(-n // BLOCK))
        place = np.empty(n, dtype=np.int64)
        place[self.members] = np.arange(n)
        place = np.repeat(place, np.diff(cut))
        held = np.bincount(term, minlength=width)
        common = held > max(BLOCK, COMMON * n)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        panel = np.zeros((int(common.sum()), self.blocks * BLOCK), dtype=np.float32)
        mine = common[term]
        panel[self.column[term[mine]], place[mine]] = weight[mine]
        self.panel = [np.ascontiguousarray(panel[:, b * BLOCK : (b + 1) * BLOCK]) for b in range(self.blocks)]
        self.most = np.stack([p.max(axis=1, initial=0) for p in self.panel], axis=1)
        by = np.argsort(term[~mine], kind="stable")
        self.place, self.light = place[~mine][by], weight[~mine][by]
        self.first = np.append(0, np.cumsum(np.where(common, 0, held)))

    def nearest(self, cut: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: the k examples of largest cosine (ties: smaller number) but skip[i], and their cosines; those with no term in common aren't near."""
        out = []
        for a in range(0, len(cut) - 1, TEXTS):
            at = cut[a : a + TEXTS + 1]
            out += self._nearest(at - at[0], term[at[0] : at[-1]], weight[at[0] : at[-1]], k, None if skip is None else skip[a : a + TEXTS])
        return out

    def _nearest(self, cut: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n, wide = len(cut) - 1, self.blocks * BLOCK
        row = np.repeat(np.arange(n), np.diff(cut))
        column = self.column[term]
        common = column >= 0
        x = np.zeros((n, len(self.most)), dtype=np.float32)
        x[row[common], column[common]] = weight[common]
        rare = np.flatnonzero(~common)
        runs = self.first[term[rare] + 1] - self.first[term[rare]]
        posting = ragged(self.first[term[rare]], runs)
        s = np.bincount(np.repeat(row[rare], runs) * wide + self.place[posting], weights=np.repeat(weight[rare], runs) * self.light[posting], minlength=n * wide)
        s = s.astype(np.float32).reshape(n, wide)
        bound = x @ self.most + s.reshape(n, self.blocks, BLOCK).max(axis=2) + SLACK
        bar = np.zeros((n, wide), dtype=bool)
        bar[:, len(self.members) :] = True
        if skip is not None:
            bar |= np.append(self.members, np.full(wide - len(self.members), -1))[None, :] == skip[:, None]
        # the best blocks first, for a cosine that the others must reach
        ahead = min(self.blocks, 1 + -(-k // 4))
        best = np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead]
        now = np.zeros((n, self.blocks), dtype=bool)
        now[np.arange(n)[:, None], best] = True
        done = np.zeros_like(now)
        for last in (False, True):
            for b in np.flatnonzero(now.any(axis=0)).tolist():
                r = np.flatnonzero(now[:, b])
                s[r, b * BLOCK : (b + 1) * BLOCK] += x[r] @ self.panel[b]
            done |= now
            seen = np.where(np.repeat(done, BLOCK, axis=1) & ~bar, s, -1)
            least = np.partition(seen, wide - k, axis=1)[:, wide - k] if wide >= k else np.full(n, -1.0)
            now = ~done & (bound >= least[:, None] - SLACK)
            if last or not now.any():
                break
        out, own = [], np.zeros(self.width)
        for i in range(n):
            found = np.flatnonzero(seen[i] >= max(least[i] - SLACK, 0))
            found = self.members[found]
            mine = slice(cut[i], cut[i + 1])
            own[term[mine]] = weight[mine]
            runs = self.cut[found + 1] - self.cut[found]
            at = ragged(self.cut[found], runs)
            exact = np.round(np.bincount(np.repeat(np.arange(len(found)), runs), weights=own[self.term[at]] * self.weight[at], minlength=len(found)), 12)
            own[term[mine]] = 0
            keep = np.lexsort((found, -exact))[:k]
            keep = keep[exact[keep] > 0]
            out.append((found[keep], exact[keep]))
        return out


@dataclass
class ToxicityModel:
    """What is sent: the examples' terms and counts; each worker makes the index from them."""

    vocabulary: Vocabulary
    idf: np.ndarray
    cut: np.ndarray  # example i has term[cut[i] : cut[i + 1]] with their counts
    term: np.ndarray
    count: np.ndarray
    toxic: np.ndarray
    ids: list
    weight: np.ndarray  # of an example with label 0, 1: members of its stratum that it stands for
    base: float
    empty: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    @cached_property
    def index(self) -> BlockMaxIndex | None:
        if len(self.cut) < 2:
            return None
        return BlockMaxIndex(self.cut, self.term, self.vectors(self.cut, self.term, self.count), len(self.idf))

    def vectors(self, cut: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Unit weights of the terms of each row."""
        w = (1 + np.log(count)) * self.idf[term]
        row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        return w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(cut) - 1))[row]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the distance-weighted votes, drawn to the base rate by one vote of weight 0.05."""
        w = self.weight[self.toxic[ids]] / (1.05 - np.minimum(cosines, 1.0))
        mean = self.weight.mean()
        p = ((w * self.toxic[ids]).sum() + 0.05 * mean * self.base) / (w.sum() + 0.05 * mean)
        p = min(max(p, 1e-4), 1 - 1e-4)
        return float(np.log(p / (1 - p)))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, list]:
        """The calibrated score of each text, and its nearest examples as (id, cosine, label)."""
        n = len(column)
        score, found = np.full(n, self.empty), [[] for _ in range(n)]
        if self.index is None:
            return score, found
        r, t, c = self.vocabulary.counts(column)
        cut = np.searchsorted(r, np.arange(n + 1))
        for i, (ids, cosines) in enumerate(self.index.nearest(cut, t, self.vectors(cut, t, c), NEIGHBOURS)):
            if len(ids):
                score[i] = 1 / (1 + np.exp(-(self.slope * self.vote(ids, cosines) + self.shift)))
                found[i] = [(self.ids[e], x, int(self.toxic[e])) for e, x in zip(ids[:5].tolist(), cosines[:5].tolist())]
        return score, found


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, drawn to slope 1 and shift 0 so that separable votes stay graded."""
    a, b = 1.0, 0.0
    w = w * len(w) / w.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() + PULL * (a - 1), r.sum() + b])
        hess = np.array([[(h * x * x).sum() + PULL, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        step = np.linalg.solve(hess, g)
        a, b = float(np.clip(a - step[0], 0.2, 3.0)), float(np.clip(b - step[1], -5.0, 5.0))
    return float(a), float(b)


def _frequencies(texts: DataFrame, vocabulary, width: int) -> tuple[np.ndarray, int]:
    """The document frequencies of `width` terms and the number of documents, from each task's packed counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, dtype=np.int64), 0
        for batch in slices(batches):
            _, t, _ = vocabulary.value.counts(batch.column(0))
            total += np.bincount(t, minlength=width)
            n += batch.num_rows
        k = np.flatnonzero(total)
        packed = [(-1, [b"", b""], n), *((b, x, 0) for b, x in pack_by(k >> _PART, k.astype("<u4"), total[k]))]
        yield pa.RecordBatch.from_pydict({"part": pa.array([b for b, _, _ in packed], pa.int32()), "k": pa.array([x[0] for _, x, _ in packed], pa.binary()), "n": pa.array([x[1] for _, x, _ in packed], pa.binary()), "rows": pa.array([m for _, _, m in packed], pa.int64())})

    def summed(table: pa.Table) -> pa.Table:
        k, n = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=kind) for c, kind in (("k", "<u4"), ("n", "<i8")))
        k, of = np.unique(k, return_inverse=True)
        n = np.bincount(of, weights=n, minlength=len(k)).astype(np.int64)
        return pa.table({"k": pa.array([k.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "rows": pa.array([sum(table["rows"].to_pylist())], pa.int64())})

    got = texts.mapInArrow(count, "part int, k binary, n binary, rows long").groupBy("part").applyInArrow(summed, "k binary, n binary, rows long").toArrow()
    df = np.zeros(width, dtype=np.int64)
    for k, n in zip(got["k"].to_pylist(), got["n"].to_pylist()):
        df[np.frombuffer(k, dtype="<u4")] = np.frombuffer(n, dtype=np.int64)
    return df, sum(got["rows"].to_pylist())


def examples(docs: DataFrame, known: DataFrame, positives: int, negatives: int) -> list[dict]:
    """doc_id, y, names, counts of at most `positives` and `negatives` rows of known (doc_id, y), by id: one for each group of copies and for each id."""
    chosen = sample(known.where("y = 1"), positives).unionByName(sample(known.where("y = 0"), negatives))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", F.xxhash64("doc_id").alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of each text; key: its smallest name of three words, which copies and most near copies share and other texts hardly ever."""
        for batch in slices(batches):
            words = Words(batch.column(2), lower=True)
            names, at = sequence_hash(words.hashes(), words.first, 3)
            key = mix(batch.column(3).to_numpy().view(U64), 31)  # too short for one: by its id
            row = words.row[at]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
            if len(row):
                key[row[first]] = np.minimum.reduceat(names, first)
            own = Words(batch.column(2), lower=True, breaks=SYMBOLS)
            found = [np.unique(x, return_counts=True) for x in np.split(own.hashes(), own.first[1:-1])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "names": pa.array([x.tobytes() for x, _ in found], pa.binary()), "counts": pa.array([n.tobytes() for _, n in found], pa.binary()), "key": pa.array(key.view(np.int64))})

    # a text copied a hundred times would make all its words look telling: one example speaks for its copies
    rows = rows.mapInArrow(terms, f"doc_id {kind}, y int, names binary, counts binary, key long")
    rows = rows.groupBy("key").agg(F.min_by(F.struct("doc_id", "y", "names", "counts"), "doc_id").alias("r")).select("r.*")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("y", "names", "counts"), "names").alias("r")).select("doc_id", "r.*")
    return rows.toArrow().sort_by("doc_id").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", positives: int = 1500, negatives: int = 3000) -> ToxicityModel:
    """Fit on at most `positives` and `negatives` labelled rows that aren't held out; document frequencies are those of all docs."""
    base_rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = learnable(labels, label).join(base_rows.select("doc_id").distinct(), "doc_id", "left_semi")
    known = checkpoint(known)
    totals = dict(known.groupBy("y").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    rate = n1 / max(n0 + n1, 1)
    empty = np.zeros(0, dtype=np.int64)
    none = ToxicityModel(Vocabulary(np.zeros(0, dtype=U64)), np.zeros(0), np.zeros(1, dtype=np.int64), empty, empty, empty, [], np.ones(2), rate, rate)
    if not n1 or not n0:
        return none
    got = examples(base_rows, known, positives, negatives)
    toxic = np.array([g["y"] for g in got], dtype=np.int64)
    m1, m0 = int((toxic == 1).sum()), int((toxic == 0).sum())
    names = [np.frombuffer(g["names"], dtype=U64) for g in got]
    vocabulary = Vocabulary(np.unique(np.concatenate(names)))
    width = len(vocabulary.names)
    if not m1 or not m0 or not width:
        return none
    n_terms = np.array([len(x) for x in names])
    term = np.searchsorted(vocabulary.names, np.concatenate(names)).astype(np.int32)
    count = np.concatenate([np.frombuffer(g["counts"], dtype=np.int64) for g in got]).astype(np.int32)
    ids = [g["doc_id"] for g in got]
    del got, names
    a, b = (np.bincount(term, weights=np.repeat(toxic == y, n_terms), minlength=width) for y in (1, 0))
    share = (a + b) / (m1 + m0)
    chi = np.divide((a / m1 - b / m0) ** 2, share * (1 - share) * (1 / m1 + 1 / m0), out=np.zeros(width), where=(share > 0) & (share < 1))
    df, n_docs = _frequencies(base_rows.select("text"), docs.sparkSession.sparkContext.broadcast(vocabulary), width)
    idf = (np.log((1 + n_docs) / (1 + df)) + 1) * (1 + np.maximum(chi - NOISE, 0) / CHI)
    weight = np.array([n0 / m0, n1 / m1])
    full = n_terms > 0
    cut = np.append(0, np.cumsum(n_terms[full]))
    model = ToxicityModel(vocabulary, idf, cut, term, count, toxic[full], [i for i, f in zip(ids, full) if f], weight, rate)
    w = weight[toxic]
    model.empty = float(((w * toxic)[~full].sum() + 0.01 * rate) / (w[~full].sum() + 0.01)) if (~full).any() else rate
    x, y, ws = [], [], []
    for k, (ids, cosines) in enumerate(model.index.nearest(cut, term, model.index.weight, NEIGHBOURS, skip=np.arange(len(cut) - 1))):
        if len(ids):
            x.append(model.vote(ids, cosines))
            y.append(model.toxic[k])
            ws.append(weight[model.toxic[k]])
    if len(set(y)) == 2:
        model.slope, model.shift = _platt(np.array(x), np.array(y, dtype=float), np.array(ws))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and evidence (nearest examples) of each row, in one pass."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, found = sent.value.scores(batch.column(1))
            evidence = pa.list_(pa.struct([("doc_id", batch.schema.field(0).type), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores), "evidence": pa.array([[{"doc_id": a, "cosine": b, "toxic": y} for a, b, y in e] for e in found], evidence)})

    return source.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},cosine:double,toxic:int>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, below: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below `below`, with all their columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(sent.value.scores(batch.column(at))[0] < below))

    return docs.mapInArrow(run, docs.schema)
