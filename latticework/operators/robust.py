"""Robust statistics by group: median, MAD, modified z-scores, modes, spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The z limit, and what scales MAD and the mean deviation to a standard deviation.
Z_MAX, MAD_SCALE, MEAN_SCALE = 3.5, 0.6745, 0.7979


#: Ranks around the middle within which values are told apart; the bounds' own error is a fifth of it.
MARGIN, ACCURACY = 5e-4, 10_000


def medians(long: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the exact median of each group; no buffer holds more than about a thousandth of a group's values.

    An approximate quantile with a proven rank error brackets the middle; values
    beyond the bracket are counted on either side, and only those inside it stay
    apart.
    """
    v = F.col(value)
    bracket = long.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(v, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("_q"))
    rows = long.where(v.isNotNull()).join(bracket, keys) if keys else long.where(v.isNotNull()).join(F.broadcast(bracket))
    place = F.when(v < F.col("_q")[0], F.lit(float("-inf"))).when(v > F.col("_q")[1], F.lit(float("inf"))).otherwise(v.cast("double"))
    counted = rows.groupBy(*keys, "_n", place.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    lists = counted.groupBy(*keys, "_n").agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_l"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("at"))
    at = lambda rank: F.aggregate("_l", start, lambda s, x: F.struct((s["seen"] + x["_c"]).alias("seen"), F.when((s["seen"] <= rank) & (rank < s["seen"] + x["_c"]), x["_v"]).otherwise(s["at"]).alias("at")))["at"]
    return lists.select(*keys, ((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias(name))


def spread(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, median, mad, mean_ad of each group."""
    off = long.join(medians(long, keys, value, "median"), keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mean = off.groupBy(*keys, "median").agg(F.avg("_d").alias("mean_ad"))
    return mean.join(medians(off, keys, "_d", "mad"), keys).select(*keys, "median", "mad", "mean_ad")


def modified_z(x: Column, median: Column, mad: Column, mean_ad: Column) -> Column:
    """By MAD; by the mean deviation where MAD is 0; 0 where both are."""
    return F.when(mad > 0, MAD_SCALE * (x - median) / mad).when(mean_ad > 0, MEAN_SCALE * (x - median) / mean_ad).otherwise(F.lit(0.0))


def outlier_scan(df: DataFrame, keys: list[str], ids: list[str], metrics: list[str], z_max: float = Z_MAX) -> DataFrame:
    """keys, ids, metric, value, median, z of the values whose modified z exceeds z_max in size; nulls take no part."""
    wide = df.select(*keys, *ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot([*keys, *ids], metrics, "metric", "value").where(F.col("value").isNotNull())
    stats = spread(long, [*keys, "metric"])
    scored = long.join(stats, [*keys, "metric"]).withColumn("z", modified_z(F.col("value"), F.col("median"), F.col("mad"), F.col("mean_ad")))
    return scored.where(F.abs("z") > z_max).select(*keys, *ids, "metric", "value", "median", "z")


def modal_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode, n of groups of which half or more share one value (ties: the smaller value)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v"))).alias("m"))
    return top.where(F.col("m.c") * -2 >= F.col("n")).select(*keys, F.col("m.v").alias("mode"), "n")


def modal_mismatch(df: DataFrame, keys: list[str], ids: list[str], value: str) -> DataFrame:
    """Rows that differ from their group's modal value."""
    return df.join(modal_value(df, keys, value), keys).where(F.col(value) != F.col("mode")).select(*keys, *ids, F.col(value).alias("value"), "mode")


def cv(column: str) -> Column:
    """Population standard deviation over the mean; 0 where the mean isn't positive."""
    return F.when(F.avg(column) > 0, F.stddev_pop(column) / F.avg(column)).otherwise(F.lit(0.0))


def upper_median(column: str) -> Column:
    """The upper of the two middles."""
    ordered = F.array_sort(F.collect_list(column))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))
