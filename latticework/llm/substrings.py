"""Substring dedup by recompression.

Each text's words are recompressed in rounds: runs of one symbol, then pairs of
a left and a right symbol, become symbols of their own.  Sides and names come
from the symbols' content by hashing, so names agree over the whole corpus
without a table, and equal word sequences get equal symbols except near their
ends.  For each symbol the span of words that its existence depends on is kept:
a symbol whose span lies inside a window stands in every text that holds the
window.  So the first such symbol of the highest level is a name that all
occurrences of the window share, whatever is around them.

Spark finds the symbols that stand for windows of two documents or more.  Their
windows are verified by the names of all their words: a window is a repeat if
the same one starts in a document with a smaller id.  Buckets of symbols are
split by salt where a passage is in very many documents, after a pre-aggregation
that brings one row for each window and batch.

Defined cases: texts without words or shorter than a window lose nothing; rows
of one id don't remove each other's words, and lose the same windows; a null id
neither removes nor loses words; windows are judged on the input; ids are whole
numbers or text of such; extra columns pass through `dedup` untouched, whatever
their names.

Windows are told apart by 64-bit names inside buckets of symbols, which add the
bucket's bits to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, mix, pack_by, ragged, sequence_hash, slices
from .spread import buckets, checkpoint, fresh, hit, slot_filter

WINDOW = 50
ROUNDS = 7
#: A bucket is split by salt above so many bytes of window names and so many times the mean bucket.
HOT_BYTES, HOT_TIMES = 1 << 20, 4


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, lo, hi) of the symbols of each level; words lo .. hi - 1 decide that the symbol is there.

    A symbol that also depends on the end of its text gets a bound beyond it.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[:-1], first[1:]
    sym, lo = names, np.arange(len(names))
    hi = lo + 1
    levels = [(mix(sym, 40), lo, hi)]
    for level in range(1, rounds + 1):
        if len(sym) < 2:
            break
        # runs: what a symbol is depends on both neighbours being others
        new = np.ones(len(sym), dtype=bool)
        new[1:] = (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(sym)))
        tail = at + length - 1
        left, right = np.maximum(at - 1, 0), np.minimum(tail + 1, len(sym) - 1)
        lo2 = np.where((at > 0) & (row[left] == row[at]), lo[left], begin[row[at]] - 1)
        hi2 = np.where((tail < len(sym) - 1) & (row[right] == row[at]), hi[right], end[row[at]] + 1)
        sym = np.where(length > 1, mix(sym[at] + U64(0x9E3779B97F4A7C15) * length.astype(U64), 2 * level), sym[at])
        lo, hi, row = np.minimum(lo2, lo[at]), np.maximum(hi2, hi[tail]), row[at]
        # pairs of a left and a right symbol
        side = (mix(sym, 100 + level) >> U64(63)).astype(bool)
        n = len(sym)
        inner = np.zeros(n, dtype=bool)
        inner[:-1] = row[1:] == row[:-1]
        merges = np.zeros(n, dtype=bool)
        merges[:-1] = inner[:-1] & ~side[:-1] & side[1:]
        gone = np.zeros(n, dtype=bool)
        gone[1:] = merges[:-1]
        after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        outer = np.append(False, inner[:-1])
        hi2 = np.where(merges, hi[after], np.where(side, hi, np.where(inner, hi[after], end[row] + 1)))
        lo2 = np.where(side & ~gone, np.where(outer, lo[before], begin[row] - 1), lo)
        sym = np.where(merges, mix(sym * U64(0xD6E8FEB86659FD93) + sym[after], 2 * level + 1), sym)
        keep = ~gone
        sym, lo, hi, row = sym[keep], np.minimum(lo, lo2)[keep], np.maximum(hi, hi2)[keep], row[keep]
        levels.append((mix(sym, 40 + level), lo, hi))
    return levels


def anchors(levels: list, at: np.ndarray, window: int) -> np.ndarray:
    """For windows that start at the words `at`: the name of the first symbol of the highest level that depends on the window alone."""
    out = np.zeros(len(at), dtype=U64)
    left = np.arange(len(at))
    for name, lo, hi in reversed(levels):
        if not len(left):
            break
        k = np.searchsorted(lo, at[left])
        inside = k < len(lo)
        k = np.minimum(k, len(lo) - 1)
        inside &= hi[k] <= at[left] + window
        out[left[inside]] = name[k[inside]]
        left = left[~inside]
    return out


class _Windows:
    """The windows of a batch: first words, rows, positions in the text, anchors, names."""

    def __init__(self, column: pa.Array, window: int):
        self.words = words = Words(column)
        names = words.hashes()
        self.keys, self.at = sequence_hash(names, words.first, window, salt=3)
        self.row = words.row[self.at]
        self.place = self.at - words.first[self.row]
        self.anchor = anchors(recompress(names, words.first), self.at, window) if len(self.at) else self.keys


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: for each document that loses words, the word ranges [start, stop) of its repeated windows, unordered and overlapping."""
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_buckets = buckets(base)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = _Windows(batch.column(1), window)
            if not len(w.at):
                continue
            fresh = np.ones(len(w.at), dtype=bool)
            fresh[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1])
            # of each symbol, one code for each text of the batch, two at most: that tells that it is shared
            name, row = w.anchor[fresh], w.row[fresh]
            order = np.lexsort((row, name))
            name, row = name[order], row[order]
            name = name[np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))]
            third = np.zeros(len(name), dtype=bool)
            third[2:] = name[2:] == name[:-2]
            name = name[~third]
            packed = list(pack_by((name % U64(n_buckets)).astype(np.int64), (name >> U64(32)).astype("<u4")))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in packed], pa.int32()), "codes": pa.array([x[0] for _, x in packed], pa.binary())})

    def code(bucket: np.ndarray, name: np.ndarray) -> np.ndarray:
        """What the filter of shared symbols goes by; codes may coincide, which only means more windows to verify."""
        return mix((bucket.astype(U64) << U64(32)) | name, 6)

    def shared(table: pa.Table) -> pa.Table:
        codes, n = np.unique(np.frombuffer(b"".join(table["codes"].to_pylist()), dtype="<u4"), return_counts=True)
        codes = codes[n > 1].astype(U64)
        return pa.table({"name": pa.array(code(np.full(len(codes), table["bucket"][0].as_py()), codes).view(np.int64))})

    common = base.mapInArrow(survey, "bucket int, codes binary").groupBy("bucket").applyInArrow(shared, "name long")
    wanted = slot_filter(common)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = _Windows(batch.column(1), window)
            use = np.flatnonzero(hit(wanted.value, code(w.anchor % U64(n_buckets), w.anchor >> U64(32))))
            if not len(use):
                continue
            row, place, anchor, keys = w.row[use], w.place[use], w.anchor[use], w.keys[use]
            new = np.ones(len(use), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(use)))
            bucket = (anchor[at] % U64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at, length, bucket = at[order], length[order], bucket[order]
            keys = keys[ragged(at, length)]
            ids, cut = np.unique(bucket, return_index=True)
            cut = np.append(cut, len(bucket))
            upto = np.append(0, np.cumsum(length))
            keys = mix(keys ^ np.repeat(anchor[at], length), 5)  # a window's name together with its symbol's
            doc, place, length = batch.column(0).to_numpy()[row[at]], place[at].astype("<u4"), length.astype("<u4")
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            part = lambda column: pa.array([column[i:j].tobytes() for i, j in spans], pa.binary())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids.astype(np.int32)), "doc": part(doc), "place": part(place), "length": part(length), "keys": pa.array([keys[upto[i] : upto[j]].tobytes() for i, j in spans], pa.binary())})

    entries = checkpoint(base.mapInArrow(windows, "bucket int, doc binary, place binary, length binary, keys binary").withColumn("part", F.monotonically_increasing_id()))
    sizes = entries.groupBy("bucket").agg(F.sum(F.length("keys")).alias("size"))
    limit = max(HOT_BYTES, int(HOT_TIMES * (sizes.agg(F.avg("size")).first()[0] or 0)))
    sizes = checkpoint(sizes.select("bucket", F.ceil(F.col("size") / limit).cast("int").alias("salts")))
    dealt = entries.join(F.broadcast(sizes), "bucket")  # a row for each bucket, 2**20 at most

    def least(name: np.ndarray, doc: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each name: the smallest and the largest document."""
        order = np.argsort(name, kind="stable")
        name = name[order]
        at = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, dtype=np.int64)
        return name[at], np.minimum.reduceat(doc[order], at) if len(at) else doc, np.maximum.reduceat(high[order], at) if len(at) else high

    def unpacked(row: dict) -> tuple[np.ndarray, ...]:
        return (np.frombuffer(row["doc"], dtype=np.int64), np.frombuffer(row["place"], dtype="<u4").astype(np.int64), np.frombuffer(row["length"], dtype="<u4").astype(np.int64), np.frombuffer(row["keys"], dtype=U64))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc, _, length, keys = unpacked(r)
                doc = np.repeat(doc, length)
                name, low, high = least(keys, doc, doc)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([r["bucket"]], pa.int32()), "name": pa.array([name.tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), dtype=kind)
        name, low, high = least(join("name", U64), join("low", np.int64), join("high", np.int64))
        many = low < high
        return pa.table({"bucket": table["bucket"].slice(0, 1), "name": pa.array([name[many].tobytes()], pa.binary()), "low": pa.array([low[many].tobytes()], pa.binary())})

    def flagged(rows: list, name: np.ndarray, low: np.ndarray) -> pa.Table:
        """Word ranges of the windows that start in a smaller document too."""
        docs, starts, stops = [], [], []
        for doc, place, length, key in rows if len(name) else ():
            doc, place = np.repeat(doc, length), ragged(place, length)
            k = np.minimum(np.searchsorted(name, key), len(name) - 1)
            f = np.flatnonzero((name[k] == key) & (low[k] < doc))
            if len(f):
                doc, place = doc[f], place[f]
                order = np.lexsort((place, doc))
                doc, place = doc[order], place[order]
                at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)))
                docs.append(doc[at])
                starts.append(place[at])
                stops.append(place[np.append(at[1:], len(place)) - 1] + window)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64())
        return pa.table({"doc_id": cat(docs), "start": cat(starts), "stop": cat(stops)})

    def alone(table: pa.Table) -> pa.Table:
        rows = [unpacked(r) for r in table.to_pylist()]
        doc = np.concatenate([np.repeat(r[0], r[2]) for r in rows])
        name, low, high = least(np.concatenate([r[3] for r in rows]), doc, doc)
        return flagged(rows, name[low < high], low[low < high])

    def salted(own: pa.Table, mins: pa.Table) -> pa.Table:
        name, low = (np.frombuffer(b"".join(mins[c].to_pylist()), dtype=k) for c, k in (("name", U64), ("low", np.int64)))
        return flagged([unpacked(r) for r in own.to_pylist()], name, low)

    kind = "doc_id long, start long, stop long"
    plain = dealt.where("salts = 1").select("bucket", "doc", "place", "length", "keys").groupBy("bucket").applyInArrow(alone, kind)
    # a bucket far above the others: smallest documents first, brought together from one row per batch, then every part of it against these
    hot = dealt.where("salts > 1").select("bucket", "salts", "part", "doc", "place", "length", "keys")
    smallest = hot.select("bucket", "doc", "place", "length", "keys").mapInArrow(partial, "bucket int, name binary, low binary, high binary").groupBy("bucket").applyInArrow(whole, "bucket int, name binary, low binary")
    smallest = smallest.join(sizes, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("bucket", "salt", "name", "low")
    parts = hot.withColumn("salt", F.pmod(F.hash("part"), F.col("salts"))).select("bucket", "salt", "doc", "place", "length", "keys")
    spans = plain.unionByName(parts.groupBy("bucket", "salt").cogroup(smallest.groupBy("bucket", "salt")).applyInArrow(salted, kind))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _cut(batch: pa.RecordBatch, text: int, spans: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, which of them are removed, and the kept words of each row joined by one space, end to end with offsets."""
    words = Words(batch.column(text))
    column = batch.column(spans)
    gone = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if len(column) - column.null_count:
        flat = column.flatten()
        row = pa.compute.list_parent_indices(column).to_numpy()
        first = words.first[row]
        np.add.at(gone, np.minimum(first + flat.field("start").to_numpy(), words.first[row + 1]), 1)
        np.add.at(gone, np.minimum(first + flat.field("stop").to_numpy(), words.first[row + 1]), -1)
    gone = np.cumsum(gone[:-1]) > 0
    keep = np.flatnonzero(~gone)
    length = words.ends[keep] - words.starts[keep]
    to = np.cumsum(length + 1) - length - 1
    out = np.full(int((length + 1).sum()), 32, dtype=np.uint8)
    out[ragged(to, length)] = words.data[ragged(words.starts[keep], length)]
    upto = np.append(to, len(out))[np.append(0, np.cumsum(~gone))[words.first]]
    return words, gone, out, upto


def _with_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """docs and, as the last column, the spans of each row."""
    of, spans = fresh(docs, "of", "spans")
    found = repeats(docs, window, id_col, text_col).select(F.col("doc_id").alias(of), F.col("spans").alias(spans))
    return docs.join(found, docs[id_col].cast("long") == F.col(of), "left").select(*docs.columns, spans)


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    rows = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), window, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, gone, out, upto = _cut(batch, 1, 2)
            raw = memoryview(out)
            lost = np.append(0, np.cumsum(gone))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array(lost[words.first[1:]] - lost[words.first[:-1]], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.string()),
            })

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words cut from the text: the kept words joined by one space.

    Texts that lose nothing stay as they are; rows that lose every word go.
    """
    rows = _with_spans(docs, window, id_col, text_col)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            words, gone, out, upto = _cut(batch, at, width)
            lost = np.append(0, np.cumsum(gone))
            lost = lost[words.first[1:]] - lost[words.first[:-1]]
            raw = out.tobytes()
            old = batch.column(at)
            text = [raw[a : max(a, b - 1)].decode() if n else t.as_py() for a, b, n, t in zip(upto[:-1].tolist(), upto[1:].tolist(), lost.tolist(), old)]
            columns = [pa.array(text, pa.string()) if k == at else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(pa.array((lost == 0) | (lost < words.counts)))

    return rows.mapInArrow(run, docs.schema)
