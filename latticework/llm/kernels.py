"""Vectorised byte and word kernels over Arrow string columns.

Every kernel works on the UTF-8 bytes of a whole batch at once: white space is
ASCII only, so words can be cut on bytes.  Word and sequence names are 64-bit
polynomial hashes with a final mix; they depend on the content alone, so they
agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that part terms: all of ASCII but letters and digits.
SYMBOLS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that the kernels take at once.
CHUNK = 1 << 20
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64; one table that serves a chunk is kept, longer ones are not."""
    size = max(n, CHUNK + 2)
    if size > CHUNK + 2 or not _powers:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > CHUNK + 2:
            return made[0], made[1]
        _powers.append((made[0], made[1]))
    return _powers[0]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x + U64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    width = np.int64 if kind == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = CHUNK, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that a slice holds about `limit` bytes of text and at most `rows` rows, or one row."""
    for batch in batches:
        _, offsets = column_bytes(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, at + rows)
            yield batch.slice(at, min(to, n) - at)
            at = to


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch of texts, or what other `breaks` (256 flags) leave together.

    starts, ends: byte positions; first: index of each row's first word, with one
    more entry at the end; row: the row of each word; data: the bytes.
    """

    def __init__(self, column: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE):
        self.data, self.offsets = column_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = np.empty(n + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_not(breaks[self.data], out=inside[1:-1])
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        at = self.offsets[:-1][self.offsets[:-1] < n]
        begins[at] = inside[1:-1][at]
        last = at[at > 0] - 1
        ends[last] = inside[1:-1][last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit name for each word."""
        return spans_hash(self.data, self.starts, self.ends, salt)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name for the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        end = int(ends[to - 1])
        up, down = powers(end - base + 1)
        total = np.empty(end - base + 1, dtype=U64)
        total[0] = 0
        np.cumsum((data[base:end].astype(U64) + U64(1)) * up[: end - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64), salt)
        at = to
    return out


def sequence_hash(names: np.ndarray, first: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of `length` consecutive words inside a row, and the index of their first words."""
    n = len(names) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    ok = np.ones(len(names) + 1, dtype=bool)
    for k in range(1, length):  # no run starts within the last words of its row
        ok[np.maximum(first[1:] - k, first[:-1])] &= first[1:] - k < first[:-1]
    at = np.flatnonzero(ok[:n])
    if length <= 4:
        total = np.zeros(len(at), dtype=U64)
        for k in range(length):
            total = (total + names[at + k]) * U64(_BASE)
        return mix(total, salt), at
    out = np.empty(len(at), dtype=U64)
    step = 1 << 18
    for i in range(0, len(at), step):
        a = at[i : i + step]
        base, end = int(a[0]), int(a[-1]) + length
        up, down = powers(end - base + 1)
        total = np.empty(end - base + 1, dtype=U64)
        total[0] = 0
        np.cumsum(names[base:end] * up[: end - base], out=total[1:])
        out[i : i + step] = mix((total[a - base + length] - total[a - base]) * down[a - base], salt)
    return out, at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def pack_by(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """For each bucket that occurs: the bytes of its part of each column."""
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(order))
    sorted_columns = [c[order] for c in columns]
    for b, lo, hi in zip(ids.tolist(), at.tolist(), ends.tolist()):
        yield b, [c[lo:hi].tobytes() for c in sorted_columns]
