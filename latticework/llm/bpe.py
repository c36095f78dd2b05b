"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves, for all distinct
pre-tokens of a batch at once, those that are whole tokens.  Tier two: every
other distinct pre-token is merged by a heap of candidate pairs over a linked
list of bytes, lowest rank first and leftmost on ties.

Pre-tokens are cut by character classes with array operations; the classes and
rules are those of the public split pattern named in `split`.

Defined cases: a null or empty text has no ids and decodes to no bytes; any
number of bytes without a break is merged in n log n; rows are independent, so
repeated rows and extra columns need no rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import U64, column_bytes, mix, ragged, slices, spans_hash

# The code points with Unicode's White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Fixed value: the pattern whose matches are pre-tokens.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Merged pre-tokens that a worker keeps for reuse, and pairs whose rank it keeps.
KEPT_WORDS, KEPT_PAIRS = 200_000, 250_000
_NONE = 1 << 40
_classes: np.ndarray | None = None
_coders: dict[str, "ByteBPE"] = {}


def char_classes() -> np.ndarray:
    """The class of each code point."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, dtype=np.uint8)
        points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start() : m.end()]] = kind
        table[WHITE] = SPACE
        _classes = table
    return _classes


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    r"""Byte positions at which pre-tokens start, over texts laid end to end.

    The rule is that of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    lead = (data & 0xC0) != 0x80
    pos = np.flatnonzero(lead)
    cp = data[pos].astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        b = np.append(data, np.zeros(3, dtype=np.uint8)).astype(np.int32)
        p, first = pos[wide], cp[wide]
        two = ((first & 0x1F) << 6) | (b[p + 1] & 0x3F)
        three = ((first & 0x0F) << 12) | ((b[p + 1] & 0x3F) << 6) | (b[p + 2] & 0x3F)
        four = ((first & 0x07) << 18) | ((b[p + 1] & 0x3F) << 12) | ((b[p + 2] & 0x3F) << 6) | (b[p + 3] & 0x3F)
        cp[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    kind = char_classes()[np.minimum(cp, 0x10FFFF)]
    n = len(cp)
    opens = np.zeros(n + 3, dtype=bool)  # first characters of texts, and the end
    opens[np.searchsorted(pos, offsets)] = True
    opens[n] = True
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    # white space before something: its last character stands alone, or joins what follows if it is a plain space
    follows = np.flatnonzero(run[1:n] & ~opens[1:n] & (kind[:-1] == SPACE)) + 1
    start[follows - 1] = True
    start[follows[cp[follows - 1] == 32]] = False
    # contractions: an apostrophe alone that starts a pre-token, and letters after it
    q = np.flatnonzero((cp == 39) & start[:n] & run[1 : n + 1] & ~opens[1 : n + 1])
    q = q[kind[np.minimum(q + 1, n - 1)] == LETTER]
    if len(q):
        c = np.append(cp, [0, 0, 0])
        c1, c2 = c[q + 1], c[q + 2]
        one = np.isin(c1, [ord(x) for x in "stmd"])
        double = (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        double &= ~run[q + 2]
        start[q[one | double] + 1] = False
        start[q[one] + 2] = True
        start[q[double & ~one] + 3] = True
    return pos[start[:n]]


class PerfectHash:
    """A minimal perfect hash of 64-bit keys by hashing and displacing: n keys, n slots."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.parts = n, max(1, n // 2)
        part = (mix(keys, 1) % U64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ids, at, sizes = np.unique(part[order], return_index=True, return_counts=True)
        self.shift = np.zeros(self.parts, dtype=np.int64)
        used = np.zeros(n, dtype=bool)
        tries = np.arange(64, dtype=U64)[:, None]
        by_size = np.argsort(-sizes, kind="stable")
        for k in by_size[: int((sizes > 1).sum())].tolist():
            own = keys[order[at[k] : at[k] + sizes[k]]][None, :]
            base = 0
            while True:
                slots = np.sort(self._slots(own, tries + U64(base)), axis=1)
                good = np.flatnonzero(~used[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1))
                if len(good):
                    used[slots[good[0]]] = True
                    self.shift[ids[k]] = base + good[0]
                    break
                base += 64
        single = by_size[int((sizes > 1).sum()) :]
        self.shift[ids[single]] = -1 - np.flatnonzero(~used)[: len(single)]
        self.keys = np.empty(n, dtype=U64)
        self.item = np.empty(n, dtype=np.int64)
        slots = self.slots(keys)
        self.keys[slots], self.item[slots] = keys, np.arange(n)

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys ^ (shift * U64(0x9E3779B97F4A7C15)), 2) % U64(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(mix(keys, 1) % U64(self.parts)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(keys, np.maximum(shift, 0).astype(U64)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 for a key that isn't there."""
        if not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        s = self.slots(keys)
        return np.where(self.keys[s] == keys, self.item[s], -1)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.ids = sorted(ranks.values())
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.tokens, self.of_rank = tokens, dict(zip(self.ids, tokens))
        self.rank_of = np.array(self.ids, dtype=np.int64)
        blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(lengths)
        self.perfect = PerfectHash(spans_hash(blob, ends - lengths, ends))
        top = self.ids[-1] + 1
        self.blob, self.at, self.length = blob, np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.int64)
        self.at[self.rank_of], self.length[self.rank_of] = ends - lengths, lengths
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.kept: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "ByteBPE":
        """The coder of a rank file (base64 token and rank on each line)."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: a heap of pairs over linked bytes."""
        symbol = [self.single[b] for b in piece]
        n = len(symbol)
        pairs, ranks, token = self.pairs, self.ranks, self.of_rank
        heap = []
        for i in range(n - 1):
            key = symbol[i] << 32 | symbol[i + 1]
            rank = pairs.get(key)
            if rank is None:
                rank = pairs[key] = ranks.get(token[symbol[i]] + token[symbol[i + 1]], _NONE)
            if rank != _NONE:
                heap.append(rank << 32 | i)
        if not heap:
            return symbol
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or pairs[symbol[i] << 32 | symbol[j]] != rank:
                continue  # the pair has changed since
            symbol[i], symbol[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                key = rank << 32 | symbol[k]
                new = pairs.get(key)
                if new is None:
                    new = pairs[key] = ranks.get(token[rank] + token[symbol[k]], _NONE)
                if new != _NONE:
                    push(heap, new << 32 | i)
            h = before[i]
            if h >= 0:
                key = symbol[h] << 32 | rank
                new = pairs.get(key)
                if new is None:
                    new = pairs[key] = ranks.get(token[symbol[h]] + token[rank], _NONE)
                if new != _NONE:
                    push(heap, new << 32 | h)
        return [s for s in symbol if s >= 0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a batch of texts, end to end, and the row offsets into them."""
        data, offsets = column_bytes(column)
        starts = split(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        bounds = np.append(starts, len(data))
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = tokens.dictionary_encode()
        index, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        blob, at = column_bytes(distinct)
        found = self.perfect.find(spans_hash(blob, at[:-1], at[1:]))
        pieces = distinct.to_pylist()
        for u in np.flatnonzero(found >= 0).tolist():
            if self.tokens[found[u]] != pieces[u]:
                found[u] = -1
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        whole, parts = self.rank_of.astype("<u4"), []
        for piece, f in zip(pieces, found.tolist()):
            if f >= 0:
                parts.append(whole[f].tobytes())
                continue
            ids = kept.get(piece)
            if ids is None:
                ids = kept[piece] = np.array(self.merge(piece), dtype="<u4").tobytes()
            parts.append(ids)
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        first = np.cumsum(lengths) - lengths
        each = lengths[index]
        ids = flat[ragged(first[index], each)]
        ends = np.append(0, np.cumsum(each))
        return ids, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, end to end, and the row offsets into them."""
        each = self.length[ids]
        out = self.blob[ragged(self.at[ids], each)]
        return out, np.append(0, np.cumsum(each))[offsets]


def coder(path: str) -> ByteBPE:
    """The worker's coder of a rank file, built once; its memory is bounded by the vocabulary and the KEPT limits."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = ByteBPE.load(path)
    return _coders[path]


def check_pattern(pattern: str) -> None:
    """Refuse a vocabulary whose pre-tokens another pattern cuts."""
    if pattern != RULE:
        raise ValueError(f"pre-tokens are cut by {RULE}, not by {pattern}")


def encode_documents(docs: DataFrame, rank_file: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """docs with n_tokens, ids (little-endian 32-bit), ids_sha256 and, if asked, decoded (the bytes of the decoded ids) and decoded_sha256.

    Columns of docs with those names are replaced.  rank_file is read on every
    executor.
    """
    return _coded(docs, rank_file, text_col, decode, keep=True)


def digest_documents(docs: DataFrame, rank_file: str, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256 of the ids decoded again."""
    return _coded(docs, rank_file, text_col, True, keep=False)


def _coded(docs: DataFrame, rank_file: str, text_col: str, decode: bool, keep: bool) -> DataFrame:
    new = ["n_tokens long", "ids_sha256 string"] + ["ids binary"] * keep + ["decoded_sha256 string"] * decode + ["decoded binary"] * (decode and keep)
    names = {x.split()[0] for x in new}
    rest = [c for c in docs.columns if c not in names and (keep or c != text_col)]
    source = docs.select(*rest, *([] if text_col in rest else [text_col]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in rest] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_file)
        for batch in slices(batches, text_col):
            ids, at = bpe.encode(batch.column(batch.schema.get_field_index(text_col)))
            raw = memoryview(np.ascontiguousarray(ids)).cast("B") if len(ids) else memoryview(b"")
            spans = [(a * 4, b * 4) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in rest}
            out["n_tokens"] = pa.array(np.diff(at), pa.int64())
            out["ids_sha256"] = pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans], pa.string())
            if keep:
                out["ids"] = pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())
            if decode:
                back, to = bpe.decode(ids, at)
                raw = memoryview(np.ascontiguousarray(back)) if len(back) else memoryview(b"")
                spans = list(zip(to[:-1].tolist(), to[1:].tolist()))
                out["decoded_sha256"] = pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans], pa.string())
                if keep:
                    out["decoded"] = pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, schema)
