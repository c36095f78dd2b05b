"""Fixed-size planes: downscale, hashes, bands, overlap, block SSIM, histograms and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


INK = 128
# The two stabilising constants of SSIM for 8-bit samples.
C1, C2 = 6.5025, 58.5225


def to_u8(values: Column) -> Column:
    """Signed values to 0..255: floor(256 v) + 128, clamped."""
    return F.transform(values, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), (F.floor(v.cast("double") * 256) + 128).cast("int"))))


def downscale(plane: Column, w: int, h: int, tw: int, th: int) -> Column:
    """Cell means rounded half up, (sum + n div 2) div n, over cells floor(t w / tw) .. at least one wide."""
    cells = []
    for y in range(th):
        y0, y1 = y * h // th, max((y + 1) * h // th, y * h // th + 1)
        for x in range(tw):
            x0, x1 = x * w // tw, max((x + 1) * w // tw, x * w // tw + 1)
            picks = [F.element_at(plane, r * w + c + 1) for r in range(y0, y1) for c in range(x0, x1)]
            total = picks[0]
            for p in picks[1:]:
                total = total + p
            cells.append(F.floor((total + len(picks) // 2) / len(picks)).cast("int"))
    return F.array(*cells)


def _bits(flags: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for k, f in enumerate(flags):
        out = out.bitwiseOR(F.when(f, F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ahash(plane: Column) -> Column:
    """64 bits of an 8x8 plane: bit y * 8 + x is set where the sample exceeds the integer mean."""
    mean = F.floor(F.aggregate(plane, F.lit(0), lambda a, x: a + x) / 64)
    return _bits([F.element_at(plane, k + 1) > mean for k in range(64)])


def dhash(plane9: Column) -> Column:
    """64 bits of a plane 9 wide and 8 high: bit y * 8 + x is set where a sample exceeds its right neighbour."""
    return _bits([F.element_at(plane9, y * 9 + x + 1) > F.element_at(plane9, y * 9 + x + 2) for y in range(8) for x in range(8)])


def band_keys(h: Column, bands: int) -> Column:
    """array(struct(band, key)) of a 64-bit hash; empty where bands doesn't divide 64."""
    if bands <= 0 or 64 % bands:
        return F.array().cast("array<struct<band:int,key:bigint>>")
    width = 64 // bands
    mask = -1 if width == 64 else (1 << width) - 1
    return F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(h, b * width).bitwiseAND(F.lit(mask).cast("long")).alias("key")) for b in range(bands)])


def lsh_candidates(hashes: DataFrame, keys: list[str], item: str, kinds: list[str], bands: int) -> DataFrame:
    """keys, a, b (a < b): distinct pairs that share a band of any hash column."""
    parts = [hashes.select(*keys, F.col(item).alias("_i"), F.lit(k).alias("_kind"), F.explode(band_keys(F.col(k), bands)).alias("_b")) for k in kinds]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.select(*keys, "_i", "_kind", "_b.band", "_b.key")
    left, right = every.withColumnRenamed("_i", "a"), every.withColumnRenamed("_i", "b")
    return left.join(right, [*keys, "_kind", "band", "key"]).where("a < b").select(*keys, "a", "b").distinct()


def ink_iou(a: Column, b: Column) -> Column:
    """Overlap of samples of INK and more; 1 where both are blank."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x >= INK) & (y >= INK)).cast("int")), F.lit(0), lambda s, x: s + x)
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: ((x >= INK) | (y >= INK)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def ssim_block(a: Column, b: Column, n: int = 64) -> Column:
    """SSIM of one block with population variances."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    sa, sb = total(F.transform(a, lambda x: x.cast("long"))), total(F.transform(b, lambda x: x.cast("long")))
    saa, sbb = total(F.transform(a, lambda x: x.cast("long") * x)), total(F.transform(b, lambda x: x.cast("long") * x))
    sab = total(F.zip_with(a, b, lambda x, y: x.cast("long") * y))
    ma, mb = sa / n, sb / n
    va, vb, cab = saa / n - ma * ma, sbb / n - mb * mb, sab / n - ma * mb
    return ((2 * ma * mb + C1) * (2 * cab + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def mae(a: Column, b: Column, n: int = 64) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x) / (n * 255)


def clusters(pairs: DataFrame, scores: DataFrame, item: str, score: str) -> DataFrame:
    """cluster, keeper, members (ascending) of confirmed pairs a, b; the keeper has the largest score (missing: 0; ties: smaller item)."""
    from .graph import connected_components

    found = connected_components(pairs, "a", "b")
    rated = found.join(scores.select(F.col(item).alias("node"), F.coalesce(score, F.lit(0)).alias("_score")), "node", "left").withColumn("_score", F.coalesce("_score", F.lit(0)))
    return rated.groupBy("component").agg(F.min_by("node", F.struct(-F.col("_score"), "node")).alias("keeper"), F.array_sort(F.collect_list("node")).alias("members")).withColumnRenamed("component", "cluster")


def histogram(df: DataFrame, keys: list[str], plane: str) -> DataFrame:
    """keys, bin, n over all samples of a group's planes."""
    return df.select(*keys, F.explode(plane).alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: the bin after which the between-class variance is largest; the first of equals."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    rows = hist.withColumn("_w", F.sum("n").over(w)).withColumn("_s", F.sum(F.col("n") * F.col("bin")).over(w)).withColumn("_n", F.sum("n").over(whole)).withColumn("_t", F.sum(F.col("n") * F.col("bin")).over(whole))
    # (S N - T W)^2 / (W (N - W)), exact integers up to the last division
    gap = (F.col("_s") * F.col("_n") - F.col("_t") * F.col("_w")).cast("double")
    rows = rows.where("_w < _n").withColumn("_v", gap * gap / (F.col("_w") * (F.col("_n") - F.col("_w"))).cast("double"))
    return rows.groupBy(*keys).agg(F.max_by("bin", F.struct("_v", -F.col("bin"))).alias("threshold"))


