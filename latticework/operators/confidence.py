"""Confidence of a sheet's grouping: six signals, weighted deductions, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ramp
from .robust import spread

# Weights by signal, and where the ramps start and end.
WEIGHTS = {"spans": 0.30, "merge_ratio": 0.20, "size_mad": 0.15, "border_touch": 0.15, "weak_grid": 0.10, "background": 0.10}
MERGE_RAMP, SIZE_RAMP, WEAK_GRID, MARGIN, CONSENSUS = (0.25, 0.75), (0.35, 0.70), (0.35, 0.75), 0.02, 0.85


def size_signal(boxes: DataFrame, sheet: str) -> DataFrame:
    """sheet, size_mad: the ramp of MAD over median of the shorter sides."""
    stats = spread(boxes.select(sheet, F.least("w", "h").cast("double").alias("value")), [sheet])
    rel = F.coalesce(F.try_divide("mad", "median"), F.lit(0.0))
    return stats.select(sheet, ramp(rel, *SIZE_RAMP).alias("size_mad"))


def border_signal(boxes: DataFrame, sheet: str, width: int, height: int) -> DataFrame:
    """sheet, border_touch: share of boxes within the margin of a border."""
    m = max(MARGIN * min(width, height), 1.0)
    near = (F.col("x") <= m) | (F.col("y") <= m) | (F.col("x") + F.col("w") >= width - m) | (F.col("y") + F.col("h") >= height - m)
    return boxes.groupBy(sheet).agg(F.avg(near.cast("double")).alias("border_touch"))


def score(boxes: DataFrame, sheet: str, width: int, height: int, evidence: DataFrame) -> DataFrame:
    """One row per sheet: n, the six signals and the score.

    evidence has, per sheet: warnings, merges, reg_x, reg_y, n_x, n_y (regularities
    and valley counts of the axes that aren't a grid; null for a grid), consensus
    (null: no background known) and kind, the background's detector; one by
    k-means or Otsu is uncertain whatever its consensus.
    """
    n = boxes.groupBy(sheet).agg(F.count(F.lit(1)).alias("n"))
    rows = n.join(size_signal(boxes, sheet), sheet).join(border_signal(boxes, sheet, width, height), sheet).join(evidence, sheet, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    weak = lambda r, k: ((F.col(r) >= WEAK_GRID[0]) & (F.col(r) <= WEAK_GRID[1]) & (F.col(k) >= 2)).cast("int")
    rows = rows.withColumns({
        "spans": F.least(F.lit(1.0), zero("warnings") / F.col("n")),
        "merge_ratio": ramp(zero("merges") / (F.col("n") + zero("merges")), *MERGE_RAMP),
        "weak_grid": (F.coalesce(weak("reg_x", "n_x"), F.lit(0)) + F.coalesce(weak("reg_y", "n_y"), F.lit(0))) / 2,
        "background": F.when(F.col("consensus").isNull(), 0.0).when(F.col("kind").isin("kmeans", "otsu"), 1.0).otherwise(ramp(CONSENSUS - F.col("consensus"), 0.0, CONSENSUS)),
    })
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return rows.select(sheet, "n", *WEIGHTS, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total)).alias("score"))
