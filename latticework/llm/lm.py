"""Stupid-backoff scores of documents under a word trigram model of the whole corpus.

The documents are packed into chunks.  Each chunk asks for the counts of its
distinct words, pairs and triples: the requests are dealt by n-gram hash into
buckets, a bucket sums the counts of all its requests into its part of the count
table and joins them back, and the answers meet their chunk again, where each
document's n-grams are scored and summed.  A request holds an n-gram once, with
its count in the chunk, so an n-gram that stands in every document costs one
entry a chunk; nothing is broadcast, cut or pooled.  Words with pairs and
triples go in two rounds, the first's shuffle being gone before the second's.

With c the counts, less what the scored document itself adds where `leave_out`
is set, and N all counted words:

    S(w | u v) = c(u v w) / c(u v)   if c(u v w) > 0, else BACKOFF * S(w | v)
    S(w | v)   = c(v w) / c(v)       if c(v w) > 0, else BACKOFF * S(w)
    S(w)       = c(w) / N            if c(w) > 0, else BACKOFF / N

The first word of a text has S(w), the second S(w | v).  Left out, a text isn't
its own evidence: what nothing else in the corpus resembles scores low, and what
occurs twice scores near 0 a word.  With its own counts no n-gram backs off.

Defined cases: each row is a document, those of a repeated or null id too; a text
without words (null, empty, white space) has 0 words, scores 0 and no mean; the
id may have any type; extra columns aren't read; an empty table gives an empty
result; with nothing but the document itself in the corpus N counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, sequence_hash, slices
from .spread import buckets, checkpoint

BACKOFF = 0.4
#: Bytes of text in a chunk, unless one text is longer; what a worker holds is about 40 times as much.
CHUNK = 4 << 20


def _coded(x: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes, byte plane by byte plane: where they are small or close, most planes compress away."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _decoded(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1).T).view(U64).ravel()


def _chunks(base: DataFrame) -> DataFrame:
    """chunk, ids, sizes, texts: rows packed together, texts compressed."""
    kind = base.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [t.encode() if t else b"" for t in table["text"].to_pylist()]
            ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table["id"].combine_chunks())
            return pa.RecordBatch.from_pydict({"ids": ids, "sizes": pa.array([_coded(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))], pa.binary()), "texts": pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(texts))], pa.binary())})

        for batch in slices(batches, limit=CHUNK):
            own = batch.column(1).nbytes
            if held and (size + own > CHUNK or sum(b.num_rows for b in held) + batch.num_rows > 1 << 15):
                yield flush()
                held, size = [], 0
            held.append(batch)
            size += own
        if held:
            yield flush()

    packed = base.mapInArrow(pack, f"ids array<{kind}>, sizes binary, texts binary")
    return checkpoint(packed.select(F.monotonically_increasing_id().alias("chunk"), "ids", "sizes", "texts"))


def _words(sizes: bytes, texts: bytes) -> Words:
    size = _decoded(sizes).view(np.int64)
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(texts, max_output_size=max(1, int(offsets[-1])))
    return Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))


def _names(words: Words, long: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, index of the last word) of all triples (`long`), or of all words and of all pairs."""
    one = words.hashes()
    if long:
        three, at = sequence_hash(one, words.first, 3, 3)
        return [(three, at + 2)]
    two, at = sequence_hash(one, words.first, 2, 2)
    return [(one, np.arange(len(one))), (two, at + 1)]


def _answers(chunks: DataFrame, n_buckets: int, long: bool) -> DataFrame:
    """chunk, bucket, counts, words: for a chunk's distinct n-grams of a bucket, by name, their counts in the corpus; words: those of the chunk, in one of its rows."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, texts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = _words(sizes, texts)
                names, n = np.unique(np.concatenate([x for x, _ in _names(words, long)]), return_counts=True)
                # buckets are ranges of names, so that a chunk's answers in the order of buckets are in the order of its names
                bucket = ((names >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)
                ids, at = np.unique(bucket, return_index=True)
                parts = list(zip(at.tolist(), [*at[1:].tolist(), len(names)]))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(ids, pa.int32()),
                    "chunk": pa.array(np.full(len(ids), chunk), pa.int64()),
                    "names": pa.array([_coded(np.diff(names[i:j], prepend=U64(0))) for i, j in parts], pa.binary()),
                    "counts": pa.array([_coded(n[i:j].astype(U64)) for i, j in parts], pa.binary()),
                    "words": pa.array(np.where(np.arange(len(ids)) == 0, len(words.starts), 0), pa.int64()),
                })

    def answer(table: pa.Table) -> pa.Table:
        names = [np.cumsum(_decoded(x), dtype=U64) for x in table["names"].to_pylist()]
        ends = np.cumsum([len(x) for x in names])
        _, of = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate([_decoded(x) for x in table["counts"].to_pylist()]).astype(np.float64)).astype(U64)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "counts": pa.array([_coded(total[x]) for x in np.split(of, ends[:-1])], pa.binary()), "words": table["words"]})

    asked = chunks.select("chunk", "sizes", "texts").mapInArrow(request, "bucket int, chunk long, names binary, counts binary, words long")
    return checkpoint(asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, counts binary, words long"))


def _others(count: np.ndarray, of: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Counts of n-grams (numbered `of`) less those inside the n-gram's own row."""
    out = count.copy()
    more = np.flatnonzero(count > 1)
    _, inverse, own = np.unique(of[more] * rows + row[more], return_inverse=True, return_counts=True)
    out[more] -= own[inverse]
    out[count == 1] = 0
    return out


def _log_scores(words: Words, total: int, counts: list[np.ndarray], backoff: float) -> np.ndarray:
    """The log score of each word; counts: of the word, pair and triple that end there (0: none, or unseen); total: N of each row."""
    one, two, three = counts
    row = words.row
    place = np.arange(len(one)) - words.first[row]
    log_backoff = float(np.log(backoff))
    log = lambda x: np.log(np.maximum(x, 1))
    before = lambda x: np.append(0, x[:-1]) if len(x) else x
    unigram = np.where(one > 0, log(one), log_backoff) - log(total)[row]
    bigram = np.where(two > 0, log(two) - log(before(one)), log_backoff + unigram)
    trigram = np.where(three > 0, log(three) - log(before(two)), log_backoff + bigram)
    return np.select([place == 0, place == 1], [unigram, bigram], trigram)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leave_out: bool = True, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score (natural log, summed over words) and mean_log_score of each row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_buckets = buckets(base)
    chunks = _chunks(base)
    short, long = (_answers(chunks, n_buckets, k) for k in (False, True))
    corpus = short.agg(F.sum("words")).first()[0] or 0
    answers = short.select("chunk", "bucket", "counts", F.lit(0).alias("round")).unionByName(long.select("chunk", "bucket", "counts", F.lit(1).alias("round")))

    def scored(mine: pa.Table, got: pa.Table) -> pa.Table:
        row = mine.slice(0, 1)
        words = _words(row["sizes"][0].as_py(), row["texts"][0].as_py())
        rows, own_row = len(words.counts), words.row
        counts = []
        got = got.sort_by([("round", "ascending"), ("bucket", "ascending")])
        for k in (False, True):
            table = got.filter(pa.compute.equal(got["round"], int(k)))
            total = np.concatenate([np.zeros(0, dtype=U64), *(_decoded(x) for x in table["counts"].to_pylist())]).astype(np.int64)
            grams = _names(words, k)
            _, of = np.unique(np.concatenate([x for x, _ in grams]), return_inverse=True)
            at = 0
            for names, last in grams:
                mine_of = of[at : at + len(names)]
                at += len(names)
                count = total[mine_of]
                out = np.zeros(len(words.starts), dtype=np.int64)
                out[last] = _others(count, mine_of, own_row[last], rows) if leave_out else count
                counts.append(out)
        n = words.counts
        value = np.bincount(own_row, weights=_log_scores(words, corpus - n * leave_out, counts, backoff), minlength=rows).astype(np.float64)
        return pa.table({"doc_id": row["ids"].combine_chunks().flatten(), "n_words": pa.array(n.astype(np.int64)), "log_score": pa.array(value), "mean_log_score": pa.array(value / np.maximum(n, 1), mask=n == 0)})

    kind = base.schema["id"].dataType.simpleString()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")
