"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Inner products become distances by one more coordinate that lifts every vector
to the largest norm (Bachrach et al., 2014); queries get 0 there.  A tree halves
vectors by their distance from a vantage point and keeps each half's distance
range; the triangle inequality then bounds from below how near a part can be.

A top tree, grown on a bounded sample, deals all vectors into shards, whose true
distance ranges from the top's vantage points are then measured; each shard gets
a tree of its own.  A query first searches the shards with the smallest bound,
which gives it a k-th distance, and then those others whose bound doesn't exceed
that distance divided by `factor`; inside a shard it visits leaves by the same
rule.  Factor 1 is exact search; a larger one skips more and may miss some.

All vectors are indexed.  A shard far above its size is cut by hash into parts,
and of equal vectors only the k + 1 smallest ids are kept in a part, as ties go
to smaller ids.  Per query and part at most k rows go on, which a window cuts.

Defined cases: null or zero vectors, other lengths than the commonest, and null
or non-finite components take no part; of rows of one id the smallest vector
counts; ids are whole numbers; ties go to the smaller id; with fewer than k candidates all are
returned; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import checkpoint

#: Vectors of a shard, of a leaf, and queries of a block.
SHARD, LEAF, QUERIES = 8192, 64, 1024
#: Vectors of the top tree's sample: so many for each shard, at most MOST_SAMPLED.
SAMPLED, MOST_SAMPLED = 32, 1 << 17
#: Shards that a query searches first.
AHEAD = 2


@dataclass
class Tree:
    vectors: np.ndarray  # in the order of the leaves
    ids: np.ndarray
    cuts: np.ndarray  # leaf i has vectors cuts[i] .. cuts[i + 1] - 1
    vantage: np.ndarray  # positions of vantage points in vectors
    paths: list  # of each leaf: vantage number, smallest and largest distance of its vectors from there


def build(vectors: np.ndarray, ids: np.ndarray, top: float) -> Tree:
    """top: the square of the largest norm."""
    lift = np.sqrt(np.maximum(0, top - (vectors * vectors).sum(axis=1)))
    wide = np.hstack([vectors, lift[:, None]])
    order, cuts, points, paths = [], [0], [], []

    def grow(own: np.ndarray, path: list) -> None:
        if len(own) <= LEAF:
            order.extend(own.tolist())
            cuts.append(len(order))
            paths.append(path)
            return
        # the vantage point: the vector farthest from the first one
        first = ((wide[own] - wide[own[0]]) ** 2).sum(axis=1)
        point = own[int(np.argmax(first))]
        d = np.sqrt(((wide[own] - wide[point]) ** 2).sum(axis=1))
        number, by = len(points), np.argsort(d, kind="stable")
        points.append(point)
        half = len(own) // 2
        for part in (by[:half], by[half:]):
            grow(own[part], [*path, (number, float(d[part].min()), float(d[part].max()))])

    grow(np.arange(len(ids)), [])
    order = np.array(order, dtype=np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return Tree(vectors[order], ids[order], np.array(cuts), place[np.array(points, dtype=np.int64)], paths)


def bounds(queries: np.ndarray, vantage: np.ndarray, paths: list, top: float) -> np.ndarray:
    """For each query and path (vantage number, smallest, largest distance): how near at least what the path holds can be."""
    norm = (queries * queries).sum(axis=1)
    out = np.zeros((len(queries), len(paths)))
    if len(vantage):
        d = np.sqrt(np.maximum(0, norm[:, None] + top - 2 * queries @ vantage.T))
        for part, path in enumerate(paths):
            for v, lo, hi in path:
                np.maximum(out[:, part], np.maximum(lo - d[:, v], d[:, v] - hi), out=out[:, part])
    return out


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, top: float, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and inner products of each query's k nearest in the tree that aren't under its floor, its own id left out."""
    norm = (queries * queries).sum(axis=1)
    n, leaves = len(queries), len(tree.paths)
    floor = np.full(n, -np.inf) if floor is None else floor
    bound = bounds(queries, tree.vectors[tree.vantage], tree.paths, top)
    by = np.argsort(bound, axis=1, kind="stable")
    best = np.full((n, k), -np.inf)  # inner products
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    todo = np.arange(n)
    slack = 1e-9 * (1 + top + norm)  # what rounding may hide
    for r in range(leaves):
        worst = np.maximum(best[todo, -1], floor[todo])
        reach = np.sqrt(np.maximum(0, norm[todo] + top - 2 * worst + slack[todo]))
        todo = todo[~(bound[todo, by[todo, r]] > reach / factor)]
        if not len(todo):
            break
        leaf = by[todo, r]
        order = np.argsort(leaf, kind="stable")
        for group in np.split(todo[order], np.flatnonzero(np.diff(leaf[order])) + 1):
            which = by[group[0], r]
            x, ids = tree.vectors[tree.cuts[which] : tree.cuts[which + 1]], tree.ids[tree.cuts[which] : tree.cuts[which + 1]]
            rough = queries[group] @ x.T
            rough[own[group][:, None] == ids[None, :]] = -np.inf
            near = rough >= np.maximum(best[group, -1], floor[group])[:, None] - slack[group][:, None]
            near &= np.isfinite(rough)
            q, c = np.nonzero(near)
            if not len(q):
                continue
            exact = (queries[group[q]] * x[c]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            touched = np.unique(q)
            all_q = np.concatenate([q, np.repeat(touched, k)])
            s = np.concatenate([exact, best[group[touched]].ravel()])
            i = np.concatenate([ids[c], best_id[group[touched]].ravel()])
            o = np.lexsort((i, -s, all_q))
            first = np.searchsorted(all_q[o], touched)
            pick = o[(first[:, None] + np.arange(k)[None, :])]
            best[group[touched]], best_id[group[touched]] = s[pick], i[pick]
    q, c = np.nonzero(np.isfinite(best))
    return q, best_id[q, c], best[q, c]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([vectors, np.sqrt(np.maximum(0, top - (vectors * vectors).sum(axis=1)))[:, None]])


@dataclass
class Top:
    """The top tree: inner nodes (vantage point, radius, inner and outer child; a child below 0 is shard -1 - child) and each shard's nodes."""

    points: np.ndarray  # lifted vantage points
    radius: list
    children: list
    paths: list

    def shards(self, wide: np.ndarray) -> np.ndarray:
        """The shard of each lifted vector."""
        at = np.full(len(wide), 0 if self.radius else -1)
        while len(todo := np.flatnonzero(at >= 0)):
            node = at[todo]
            far = np.sqrt(((wide[todo] - self.points[node]) ** 2).sum(axis=1)) > np.asarray(self.radius)[node]
            at[todo] = np.asarray(self.children)[node, far.astype(int)]
        return -1 - at

    def distances(self, wide: np.ndarray, shard: int) -> np.ndarray:
        """Distances of the vectors from the vantage points above a shard."""
        return np.sqrt(((wide[:, None, :] - self.points[self.paths[shard]][None]) ** 2).sum(axis=2))


def plan(sample: np.ndarray, shards: int, top: float) -> Top:
    """A top tree of about so many shards over a sample."""
    wide = lifted(sample, top)
    points, radius, children, paths = [], [], [], []

    def grow(own: np.ndarray, share: int, path: list) -> int:
        if share > 1 and len(own) >= 2:
            first = ((wide[own] - wide[own[0]]) ** 2).sum(axis=1)
            point = own[int(np.argmax(first))]
            d = np.sqrt(((wide[own] - wide[point]) ** 2).sum(axis=1))
            cut = float(np.median(d))
            if 0 < (d > cut).sum():
                number = len(points)
                points.append(wide[point])
                radius.append(cut)
                children.append(None)
                children[number] = [grow(own[d <= cut], share - share // 2, [*path, number]), grow(own[d > cut], share // 2, [*path, number])]
                return number
        paths.append(path)
        return -len(paths)

    grow(np.arange(len(wide)), shards, [])
    return Top(np.array(points).reshape(len(points), wide.shape[1]), radius, children, paths)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest vectors found for each row of queries."""

    def valid(df: DataFrame, size: int | None = None) -> DataFrame:
        v = F.col("v")
        ok = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ok)
        return df if size is None else df.where(F.size("v") == size)

    every = valid(vectors)
    sizes = every.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count, top = sizes["d"], sizes["n"], float(sizes["top"]) * (1 + 1e-12)
    shards = min(-(-count // SHARD), MOST_SAMPLED // SAMPLED)
    drawn = valid(vectors, dim).orderBy(F.xxhash64("id"), "id").limit(min(MOST_SAMPLED, SAMPLED * shards)).toArrow().sort_by("id")
    root = spark.sparkContext.broadcast(plan(_matrix(drawn["v"]), shards, top))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shard = root.value.shards(lifted(_matrix(batch.column(1)), top))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard, pa.int64())], names=["id", "v", "shard"])

    dealt = checkpoint(valid(vectors, dim).mapInArrow(deal, "id long, v array<double>, shard long"))
    again = checkpoint(dealt.groupBy("id").count().where("count > 1").select(F.col("id").alias("i")))
    if not again.isEmpty():
        least = dealt.join(again, F.col("id") == F.col("i"), "left_semi").groupBy("id").agg(F.min(F.struct("v", "shard")).alias("r"))
        dealt = checkpoint(dealt.join(again, F.col("id") == F.col("i"), "left_anti").unionByName(least.select("id", "r.v", "r.shard")))
    parts = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD)).alias("parts"))  # one row for each shard, MOST_SAMPLED / SAMPLED at most

    def plant(table: pa.Table) -> pa.Table:
        shard, ids, x = table["shard"][0].as_py(), table["id"].to_numpy(), _matrix(table["v"])
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        # of equal vectors the k + 1 smallest ids: others come after k ties
        place = np.arange(len(ids))
        first = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        keep = place - np.maximum.accumulate(np.where(first, place, 0)) <= k
        x, ids = x[keep], ids[keep]
        tree = build(x, ids, top)
        d = root.value.distances(lifted(x, top), shard)
        paths = [[y for step in p for y in step] for p in tree.paths]
        return pa.table({"shard": table["shard"].slice(0, 1), "part": table["part"].slice(0, 1), "x": pa.array([tree.vectors.tobytes()], pa.binary()), "ids": pa.array([tree.ids.tobytes()], pa.binary()), "cuts": pa.array([tree.cuts.tolist()], pa.list_(pa.int64())), "vantage": pa.array([tree.vantage.tolist()], pa.list_(pa.int64())), "paths": pa.array([paths], pa.list_(pa.list_(pa.float64()))), "lo": pa.array([d.min(axis=0).tolist()], pa.list_(pa.float64())), "hi": pa.array([d.max(axis=0).tolist()], pa.list_(pa.float64()))})

    kind = "shard long, part long, x binary, ids binary, cuts array<bigint>, vantage array<bigint>, paths array<array<double>>, lo array<double>, hi array<double>"
    index = dealt.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("shard", "part", "id", "v").groupBy("shard", "part").applyInArrow(plant, kind)
    index = checkpoint(index)
    # a shard is searched where the bound by its own distance ranges allows
    measured = index.select("shard", F.posexplode(F.arrays_zip("lo", "hi"))).groupBy("shard", "pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"))
    ranges = {(r["shard"], r["pos"]): (r["lo"], r["hi"]) for r in measured.collect()}
    held = sorted(r["shard"] for r in parts.collect())
    paths = [[(v, *ranges[shard, pos]) for pos, v in enumerate(root.value.paths[shard])] for shard in held]
    targets = spark.sparkContext.broadcast((np.array(held), paths))
    asked = checkpoint(valid(queries, dim).groupBy("id").agg(F.min("v").alias("v")).withColumn("floor", F.lit(float("-inf"))))

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (names, paths), points = targets.value, root.value.points
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    own = batch.slice(at, QUERIES)
                    x, floor = _matrix(own.column(1)), own.column(2).to_numpy()
                    norm = (x * x).sum(axis=1)
                    bound = bounds(np.hstack([x, np.zeros((len(x), 1))]), points, paths, top)
                    ahead = np.zeros(bound.shape, dtype=bool)
                    ahead[np.arange(len(x))[:, None], np.argsort(bound, axis=1, kind="stable")[:, :AHEAD]] = True
                    slack = 1e-9 * (1 + top + norm)
                    reach = np.sqrt(np.maximum(0, norm + top - 2 * floor + slack))
                    q, t = np.nonzero(ahead if first else ~ahead & (bound <= reach[:, None] / factor))
                    rows = own.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[t])], names=["id", "v", "floor", "shard"])

        return run

    def gather(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table["shard"].slice(0, 1), "q": pa.array([_matrix(table["v"]).tobytes()], pa.binary()), "q_ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()), "q_floor": pa.array([table["floor"].to_numpy().tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tree = Tree(np.frombuffer(r["x"]).reshape(-1, dim), np.frombuffer(r["ids"], dtype=np.int64), np.array(r["cuts"]), np.array(r["vantage"], dtype=np.int64), [[(int(p[i]), p[i + 1], p[i + 2]) for i in range(0, len(p), 3)] for p in r["paths"]])
                ids = np.frombuffer(r["q_ids"], dtype=np.int64)
                q, found, score = search(tree, np.frombuffer(r["q"]).reshape(-1, dim), ids, top, k, factor, np.frombuffer(r["q_floor"]))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[q]), "vec_id": pa.array(found), "score": pa.array(score)})

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        sent = checkpoint(asking.select("id", "v", "floor").mapInArrow(route(first), "id long, v array<double>, floor double, shard long"))
        # as many blocks of a shard's queries as there are thousands of them, and each block to each part
        counts = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks"))
        blocks = sent.join(F.broadcast(counts), "shard").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).select("shard", "block", "id", "v", "floor")
        packed = blocks.groupBy("shard", "block").applyInArrow(gather, "shard long, q binary, q_ids binary, q_floor binary")
        packed = packed.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = packed.join(index.drop("lo", "hi"), ["shard", "part"]).select("q", "q_ids", "q_floor", "x", "ids", "cuts", "vantage", "paths")
        return checkpoint(met.mapInArrow(run, "query_id long, vec_id long, score double"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = searched(asked, True)
    if len(held) > AHEAD:
        worst = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("w"))
        asked = asked.join(worst, F.col("id") == F.col("q"), "left").select("id", "v", F.coalesce("w", "floor").alias("floor"))
        found = found.unionByName(searched(asked, False))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
