"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

Each distinct set of word n-grams is a row of the incidence matrix.  Bounds
derived from set sizes keep the product sparse: two sets of Jaccard similarity
t share at least OVERLAP n-grams among the first `n - ceil(t n) + OVERLAP` of
each in any common order, so only those columns are multiplied, overlap counts
are accumulated per pair, and pairs below the count or of unfit sizes are
discarded.  The order puts n-grams that many sets share last.  Remaining pairs
are verified on whole sets.

Sets of columns that many share aren't paired row by row: they are dealt into
blocks by group, size class and hash, whole blocks are multiplied, and each
product gives the links of a spanning forest only.  Components are exact and
groups of thousands of near copies cost rows in proportion to their sets.

Names: n-grams and sets are compared by 64-bit hashes.

Defined cases: a null or wordless text has the empty set and links with nothing;
fewer words than n make one n-gram; equal sets always link; the component of a
row is the smallest id reachable, its own where the id is null or alone; ids are
whole numbers or text of such; `components` keeps repeated rows and reads no
extra columns; `keep_one` keeps one row of each component, whatever the ids:
that of the smallest id (null last), and one of rows that repeat its id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .kernels import U64, Words, mix, pack_by, ragged, sequence_hash, slices
from .spread import buckets, checkpoint, fresh, hit, slot_filter

#: Shared n-grams that a pair must show among the leading ones.
OVERLAP = 3
#: An n-gram that more sets than this lead with goes last in the order; n-grams so moved, at most (8 bytes each, broadcast).
HOT, HOT_MAX = 16, 1 << 20
#: Sets of one column up to which all its pairs are multiplied out at once; sets of a block; pairs from which a column is dense, and columns of a dense panel.
SQUARE, BLOCK, PANEL = 16, 1024, 2048


def ngram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram names of each text, ascending, end to end, and the row offsets into them."""
    words = Words(column, lower=True)
    names = words.hashes()
    grams, at = sequence_hash(names, words.first, n)
    row = words.row
    size = np.where(words.counts < n, words.counts > 0, words.counts - n + 1)
    first = np.append(0, np.cumsum(size))
    keys = np.empty(int(first[-1]), dtype=U64)
    long = (words.counts >= n)[np.repeat(np.arange(len(size)), size)]
    keys[long] = grams
    for k in range(1, n):  # too short for an n-gram
        short = np.flatnonzero(words.counts == k)
        if len(short):
            g, at = sequence_hash(names, words.first, k, salt=n - k)
            keys[first[short]] = g[words.counts[row[at]] == k]
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        keys[i:j].sort()
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    fresh[first[:-1][size > 0]] = True
    return keys[fresh], np.append(0, np.cumsum(fresh))[first]


def set_names(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.append(U64(0), np.cumsum(mix(keys, 7)))
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64), 8)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _leading(keys: np.ndarray, first: np.ndarray, many: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which keys are among the first `many` of their set in the order (hot last, then by name)."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    cold = np.append(0, np.cumsum(~hot))
    before = cold[:-1] - cold[first[:-1]][owner]
    place = np.where(hot, (cold[first[1:]] - cold[first[:-1]])[owner] + np.arange(len(keys)) - first[:-1][owner] - before, before)
    return place < many[owner]


def _once(names: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Rows that stand for their set within the batch: those of the smallest id."""
    order = np.lexsort((ids.fill_null(np.iinfo(np.int64).max).to_numpy(), names))
    _, at = np.unique(names[order], return_index=True)
    return np.sort(order[at])


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (its 64-bit hash), n, node, comp of each row of docs: the names of its set and of the set's component, null without words."""
    if not 75 <= percent <= 100:
        raise ValueError("the count bound holds for similarities of 75 percent and more")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_buckets = buckets(base)
    hashed = base.withColumn("h", F.xxhash64("text"))
    short = OVERLAP * 100 // percent + 100 // (100 - percent) if percent < 100 else 1 << 40
    smallest = min((k for k in range(1, 1 + short) if -(-(k + 1) * percent // 100) <= k), default=1 << 40)  # smaller sets link with equal ones only

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, first = ngram_sets(batch.column(1), n)
            names, size = set_names(keys, first), np.diff(first)
            yield _rows(doc_id=batch.column(0), h=batch.column(2), n=pa.array(size), node=pa.array(names.view(np.int64), mask=size == 0))
            rows = _once(names, batch.column(0))
            rows = rows[size[rows] >= smallest]
            many = np.minimum(2 * (size[rows] - _least(size[rows], percent) + OVERLAP), size[rows])
            code = mix(keys[ragged(first[rows], many)], 9)
            code.sort()
            _, at, count = np.unique(code, return_index=True, return_counts=True)
            code = code[ragged(at, np.minimum(count, HOT + 1))]  # more would tell no more
            if len(code):
                packed = list(pack_by((code % U64(n_buckets)).astype(np.int64), (code >> U64(32)).astype("<u4")))
                yield _rows(bucket=pa.array([b for b, _ in packed], pa.int32()), blob=pa.array([x[0] for _, x in packed], pa.binary()))

    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def _rows(**columns: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    seen = checkpoint(hashed.mapInArrow(survey, "doc_id long, h long, n long, node long, bucket int, blob binary"))
    info = seen.where("bucket is null").select("doc_id", "h", "n", "node")
    quota = max(1, HOT_MAX // n_buckets)

    def frequent(table: pa.Table) -> pa.Table:
        codes, count = np.unique(np.frombuffer(b"".join(table["blob"].to_pylist()), dtype="<u4"), return_counts=True)
        pick = np.flatnonzero(count > HOT)
        pick = pick[np.argsort(-count[pick], kind="stable")[:quota]]
        return pa.table({"bucket": pa.array(np.full(len(pick), table["bucket"][0].as_py()), pa.int64()), "code": pa.array(codes[pick].astype(np.int64))})

    hot = seen.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(frequent, "bucket long, code long").toArrow()
    hot = np.sort((hot["bucket"].to_numpy().astype(U64) << U64(32)) | hot["code"].to_numpy().astype(U64))
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in slices(batches):
            keys, first = ngram_sets(batch.column(1), n)
            names, size = set_names(keys, first), np.diff(first)
            rows = _once(names, batch.column(0))
            rows = rows[size[rows] >= smallest]
            own, at = keys[ragged(first[rows], size[rows])], np.append(0, np.cumsum(size[rows]))
            if len(hot):
                code = mix(own, 9)
                code = ((code % U64(n_buckets)) << U64(32)) | (code >> U64(32))
                is_hot = hot[np.minimum(np.searchsorted(hot, code), len(hot) - 1)] == code
            else:
                is_hot = np.zeros(len(own), dtype=bool)
            chosen = _leading(own, at, size[rows] - _least(size[rows], percent) + OVERLAP, is_hot)
            owner = np.repeat(np.arange(len(rows)), size[rows])
            cold, warm = chosen & ~is_hot, chosen & is_hot
            node, k = names[rows], own[cold]
            packed = list(pack_by((mix(k, 10) % U64(n_buckets)).astype(np.int64), k, node[owner[cold]], size[rows][owner[cold]].astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int32()), *[pa.array([x[i] for _, x in packed], pa.binary()) for i in range(3)], *[pa.nulls(len(packed), pa.int64())] * 4], names=lead_names)
            # hot n-grams go row by row: as many sets as there are may share one
            reach = np.bincount(owner[cold], minlength=len(rows))
            o = owner[warm]
            columns = [pa.array(x.astype(np.int64)) for x in (own[warm], node[o].view(np.int64), size[rows][o], reach[o])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(o), pa.int32()), *[pa.nulls(len(o), pa.binary())] * 3, *columns], names=lead_names)

    lead_names = ["bucket", "keys", "nodes", "sizes", "key", "node", "n", "reach"]
    leads = checkpoint(base.mapInArrow(lead, "bucket int, keys binary, nodes binary, sizes binary, key long, node long, n long, reach long"))

    def multiply_cold(table: pa.Table) -> pa.Table:
        """Of a bucket's columns with two sets or more: pairs of fitting sizes with their overlap counts (kind 0), each set's number of such columns (1), and the sets of columns too long to square (2)."""
        key, node, size = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=k) for c, k in (("keys", U64), ("nodes", np.int64), ("sizes", "<u4")))
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order].astype(np.int64)
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])) if len(key) else np.zeros(0, dtype=bool)
        key, node, size = key[new], node[new], size[new]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(at, len(key)))
        long = count > SQUARE
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for c in range(2, SQUARE + 1):
            of = at[count == c]
            if len(of):
                i, j = np.triu_indices(c, 1)
                a.append((of[:, None] + i[None, :]).ravel())
                b.append((of[:, None] + j[None, :]).ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        fit = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = node[a[fit]], node[b[fit]]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(first, len(a)))
        of = ragged(at[count > 1], count[count > 1])
        mine, n_mine = np.unique(node[of], return_counts=True)
        rest = ragged(at[long], count[long])
        centre = np.repeat(node[at[long]], count[long])
        zero = lambda m: np.zeros(m, dtype=np.int64)
        return pa.table({
            "kind": pa.array(np.repeat([0, 1, 2], [len(first), len(mine), len(rest)]).astype(np.int32)),
            "a": pa.array(np.concatenate([a[first], mine, node[rest]])),
            "b": pa.array(np.concatenate([b[first], zero(len(mine)), centre])),
            "k": pa.array(np.concatenate([times, n_mine, size[rest]]).astype(np.int64)),
        })

    cold = checkpoint(leads.where("bucket is not null").select("bucket", "keys", "nodes", "sizes").groupBy("bucket").applyInArrow(multiply_cold, "kind int, a long, b long, k long"))
    counted = cold.where("kind = 0").groupBy("a", "b").agg(F.sum("k").alias("k"))
    links = _verified(base, info, checkpoint(counted.where(f"k >= {OVERLAP}").select("a", "b")), n, percent)

    # Columns of many sets: their sets in blocks.  Two sets that meet in a hot
    # column have all their other n-grams among the leading ones, so those that
    # stand in no other set's leading ones are in no common subset; a set that
    # has too many of these links with none there.
    known = cold.where("kind = 1").groupBy(F.col("a").alias("_n")).agg(F.sum("k").alias("_k"))
    entries = leads.where("bucket is null").groupBy("key", "node").agg(F.first("n").alias("n"), F.first("reach").alias("reach"))
    columns = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("centre")).where("c > 1")
    hot_sets = entries.join(columns, "key").join(known, F.col("node") == F.col("_n"), "left").withColumn("most", F.col("n") - F.col("reach") + F.coalesce("_k", F.lit(0)))
    hot_sets = hot_sets.where(f"most * {100 + percent} >= {percent} * (n + ceil({percent} * n / 100))").select("node", "n", "centre")
    large = checkpoint(hot_sets.unionByName(cold.where("kind = 2").select(F.col("a").alias("node"), F.col("k").alias("n"), F.col("b").alias("centre"))).distinct())
    if not large.isEmpty():
        links = links.unionByName(_blocked(base, info, large, n, percent))
    joined = connected_components(links, "a", "b")

    joined = joined.select(F.col("node").alias("_n"), "component")
    return info.join(joined, F.col("node") == F.col("_n"), "left").select("doc_id", F.col("h").alias("text"), "n", "node", F.coalesce("component", "node").alias("comp"))


def components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id linked to, directly or not): one row for each row of docs.

    Two texts link when 100 * |intersection| >= percent * |union| of their n-gram sets.
    """
    found = checkpoint(_classes(docs, n, percent, id_col, text_col))
    least = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("comp", "_c")
    out = found.join(least, F.col("comp") == F.col("_c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _sets(base: DataFrame, info: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, s (its n-gram names): the whole sets of the names in nodes, read from one text each."""
    wanted = slot_filter(nodes)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, first = ngram_sets(batch.column(1), n)
            names = set_names(keys, first)
            rows = _once(names, batch.column(0))
            rows = rows[hit(wanted.value, names[rows]) & (np.diff(first)[rows] > 0)]
            yield pa.RecordBatch.from_pydict({"node": pa.array(names[rows].view(np.int64)), "d": batch.column(0).take(pa.array(rows)), "s": pa.array([keys[first[r] : first[r + 1]].tobytes() for r in rows.tolist()], pa.binary())})

    keepers = info.groupBy("node").agg(F.min("doc_id").alias("d")).join(nodes, F.col("node") == F.col("name"), "left_semi")
    found = base.mapInArrow(fetch, "node long, d long, s binary").withColumnRenamed("node", "_n").withColumnRenamed("d", "_d")
    return checkpoint(found.join(keepers, (F.col("_n") == F.col("node")) & F.col("_d").eqNullSafe(F.col("d"))).select("node", "s"))


def _verified(base: DataFrame, info: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set names whose whole sets reach the similarity."""
    sets = _sets(base, info, pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct(), n)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                good[k] = 100 * inter >= percent * (len(p) + len(q) - inter)
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return checkpoint(both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long").distinct())


def product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all sets of two blocks: the product of their incidence matrices, column by shared column.

    Columns that many sets of both blocks share are multiplied as dense panels,
    the others pair by pair.
    """
    sizes = [np.fromiter(map(len, side), dtype=np.int64, count=len(side)) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), size) for side, size in zip((left, right), sizes)]
    keys = [np.concatenate(side) for side in (left, right)]
    order = [np.argsort(k, kind="stable") for k in keys]
    keys, rows = [k[o] for k, o in zip(keys, order)], [r[o] for r, o in zip(rows, order)]
    names, first, count = zip(*(np.unique(k, return_index=True, return_counts=True) for k in keys))
    _, i, j = np.intersect1d(names[0], names[1], assume_unique=True, return_indices=True)
    a_at, a_n, b_at, b_n = first[0][i], count[0][i], first[1][j], count[1][j]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    dense = np.flatnonzero(a_n * b_n >= PANEL)
    for c in range(0, len(dense), PANEL):
        part = dense[c : c + PANEL]
        panels = []
        for at, size, row, height in ((a_at, a_n, rows[0], len(left)), (b_at, b_n, rows[1], len(right))):
            panel = np.zeros((height, len(part)), dtype=np.float32)
            panel[row[ragged(at[part], size[part])], np.repeat(np.arange(len(part)), size[part])] = 1
            panels.append(panel)
        out += panels[0] @ panels[1].T
    thin = np.flatnonzero(a_n * b_n < PANEL)
    for part in np.array_split(thin, max(1, int((a_n[thin] * b_n[thin]).sum()) >> 21)):
        # each set of the left side against the run of sets of the right side
        mine = rows[0][ragged(a_at[part], a_n[part])]
        runs = np.repeat(b_n[part], a_n[part])
        theirs = rows[1][ragged(np.repeat(b_at[part], a_n[part]), runs)]
        out += np.bincount(np.repeat(mine, runs) * len(right) + theirs, minlength=out.size).reshape(out.shape)
    return out.astype(np.int64)


def _blocked(base: DataFrame, info: DataFrame, large: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that join the sets of large columns as all their links would.

    Sets that columns connect form a group; a group is cut by size class and hash
    into blocks of about BLOCK sets, and blocks of fitting sizes are multiplied.
    A task gives the links of a spanning forest only, so rows grow with the sets.
    """
    groups = connected_components(large.select(F.col("node").alias("a"), F.col("centre").alias("b")), "a", "b").select(F.col("node").alias("_n"), F.col("component").alias("g"))
    size_class = F.floor(F.log("n") / np.log(1.05)).cast("int")
    nodes = large.select("node", "n").distinct().join(groups, F.col("node") == F.col("_n")).select("node", "g", size_class.alias("s"))
    counts = nodes.groupBy("g", "s").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    nodes = checkpoint(nodes.join(counts, ["g", "s"]).withColumn("r", F.pmod(F.xxhash64("node"), F.col("parts"))).select("node", "g", "s", "r"))
    sets = _sets(base, info, nodes.select(F.col("node").alias("name")), n)

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy())
        table = table.take(pa.array(order))
        blobs = table["set"].to_pylist()
        ends = np.cumsum([len(b) // 8 for b in blobs])
        return pa.table({k: table[k].slice(0, 1) for k in ("g", "s", "r")} | {"nodes": pa.array([table["node"].to_numpy().tobytes()], pa.binary()), "ends": pa.array([ends.astype(np.int64).tobytes()], pa.binary()), "keys": pa.array([b"".join(blobs)], pa.binary())})

    rows = nodes.join(sets.withColumnRenamed("node", "_n").withColumnRenamed("s", "set"), F.col("node") == F.col("_n")).select("g", "s", "r", "node", "set")
    blocks = checkpoint(rows.groupBy("g", "s", "r").applyInArrow(pack, "g long, s int, r long, nodes binary, ends binary, keys binary"))
    reach = int(np.ceil(np.log(100 / percent) / np.log(1.05))) + 1
    # pairs of block numbers first, then each side's content by its own number: a large group's blocks spread over tasks
    x, y = (blocks.select("g", *[F.col(c).alias(f"{p}_{c}") for c in "sr"]) for p in "xy")
    meet = x.join(y, "g").where(f"y_s between x_s and x_s + {reach} and (y_s > x_s or y_r >= x_r)")
    for p in "xy":
        content = blocks.select("g", *[F.col(c).alias(f"{p}_{c}") for c in ("s", "r", "nodes", "ends", "keys")])
        meet = meet.join(content, ["g", f"{p}_s", f"{p}_r"])
    meet = meet.select(*[f"{p}_{c}" for p in "xy" for c in ("nodes", "ends", "keys")])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides = []
                for p in "xy":
                    ends, keys = np.frombuffer(row[f"{p}_ends"], dtype=np.int64), np.frombuffer(row[f"{p}_keys"], dtype=U64)
                    sides.append((np.frombuffer(row[f"{p}_nodes"], dtype=np.int64), np.split(keys, ends[:-1])))
                (a, left), (b, right) = sides
                inter = product(left, right)
                total = np.fromiter(map(len, left), dtype=np.int64)[:, None] + np.fromiter(map(len, right), dtype=np.int64)[None, :]
                i, j = np.nonzero((100 * inter >= percent * (total - inter)) & (a[:, None] != b[None, :]))
                root: dict[int, int] = {}
                keep = []
                for u, v in zip(a[i].tolist(), b[j].tolist()):
                    ru, rv = u, v
                    while (up := root.get(ru, ru)) != ru:
                        root[ru] = root.get(up, up)
                        ru = up
                    while (up := root.get(rv, rv)) != rv:
                        root[rv] = root.get(up, up)
                        rv = up
                    if ru != rv:
                        root[ru] = rv
                        keep.append((u, v))
                pairs = np.array(keep, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))})

    return checkpoint(meet.mapInArrow(multiply, "a long, b long").distinct())


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id (null last, then the text's hash); texts without words all stay."""
    rows = checkpoint(_classes(docs, n, percent, id_col, text_col).where("comp is not null").select("doc_id", "text", "comp"))
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text")).alias("k"))
    rows = rows.join(first.withColumnRenamed("comp", "_c"), F.col("comp") == F.col("_c"))
    kept = F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.col("text") == F.col("k.text"))
    # rows are told by id and text: gone, or kept by several rows of which one stays
    gone, h = fresh(docs, "gone", "h")
    marked = rows.groupBy("doc_id", "text").agg(F.bool_and(kept).alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    marked = checkpoint(marked.select(F.struct("doc_id", "text", "kept").alias(gone)))
    wide = docs.withColumn(h, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone)["doc_id"]) & (F.col(h) == F.col(gone)["text"])
    out = wide.join(marked, same, "left_anti")
    several = marked.where(F.col(gone)["kept"])
    if not several.isEmpty():
        out = out.unionByName(wide.join(several, same, "left_semi").dropDuplicates([id_col, text_col]))
    return out.select(*docs.columns)
