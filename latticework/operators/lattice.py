"""Lattice hints: ink profiles, valleys between cells, their regularity, and boxes against valleys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def profile(boxes: DataFrame, sheet: str, at: str = "x", size: str = "w", weight: str = "h") -> DataFrame:
    """sheet, at, stop, ink: pieces of the axis with the summed weight of the boxes over them.

    Each box adds its weight where it starts and takes it off where it ends; a
    running sum over these marks is the profile, without one row per pixel.
    """
    marks = boxes.select(sheet, F.col(at).alias("at"), F.col(weight).cast("long").alias("d")).unionByName(boxes.select(sheet, (F.col(at) + F.col(size)).alias("at"), (-F.col(weight)).cast("long").alias("d")))
    marks = marks.groupBy(sheet, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(sheet).orderBy("at")
    return marks.select(sheet, "at", F.lead("at").over(w).alias("stop"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("ink")).where("stop is not null")


def valleys(pieces: DataFrame, sheet: str) -> DataFrame:
    """sheet, centre of each inner gap: the middle (first + last) div 2 of its pixels; margins aren't gaps."""
    return pieces.where("ink = 0").select(sheet, F.expr("cast((at + stop - 1) div 2 as int)").alias("centre"))


def regularity(centres: DataFrame, sheet: str) -> DataFrame:
    """sheet, n_valleys, pitch, regularity: 1 - MAD / median of the pitches, both by the upper middle, 0 with fewer than two valleys."""
    w = Window.partitionBy(sheet).orderBy("centre")
    steps = centres.withColumn("step", F.col("centre") - F.lag("centre").over(w))
    base = steps.groupBy(sheet).agg(F.count(F.lit(1)).alias("n_valleys"), F.array_sort(F.collect_list("step")).alias("s"))
    base = base.withColumn("pitch", F.when(F.size("s") > 0, F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int"))))
    off = F.array_sort(F.transform("s", lambda x: F.abs(x - F.col("pitch"))))
    mad = F.when(F.size("s") > 0, F.element_at(off, (F.floor(F.size("s") / 2) + 1).cast("int")))
    value = F.greatest(F.lit(0.0), 1 - F.try_divide(mad.cast("double"), F.col("pitch").cast("double")))
    return base.select(sheet, "n_valleys", "pitch", F.coalesce(F.when(F.col("n_valleys") >= 2, value), F.lit(0.0)).alias("regularity"))


def _covers(valleys: Column, start: Column, stop: Column, tol: int) -> Column:
    return F.exists(valleys, lambda c: (start <= c - tol) & (stop > c + tol))


def _cell(valleys: Column, start: Column, stop: Column) -> Column:
    return F.size(F.filter(valleys, lambda c: c <= F.floor((start + stop) / 2)))


def classify(boxes: DataFrame, x_valleys: DataFrame, y_valleys: DataFrame, sheet: str, tol: int = 2) -> DataFrame:
    """boxes with col, row (cells counted from 0) and axes: 1 and 2 mark axes on which the box covers a valley by more than tol."""
    out = boxes
    for name, lo, size, found in (("col", "x", "w", x_valleys), ("row", "y", "h", y_valleys)):
        lists = found.groupBy(sheet).agg(F.array_sort(F.collect_list("centre")).alias(f"_{name}"))
        out = out.join(lists, sheet, "left")
        v = F.coalesce(F.col(f"_{name}"), F.array().cast("array<int>"))
        start, stop = F.col(lo), F.col(lo) + F.col(size)
        out = out.withColumn(f"_span_{name}", _covers(v, start, stop, tol)).withColumn(name, _cell(v, start, stop))
    return out.withColumn("axes", F.col("_span_col").cast("int") + 2 * F.col("_span_row").cast("int")).drop("_col", "_row", "_span_col", "_span_row")
