"""Run-length masks: runs of planes, the way back, and 8-connected components of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components


def plane_runs(df: DataFrame, keys: list[str], plane: str, width: int, ink: Column | None = None) -> DataFrame:
    """keys, y, x_start, x_end of the maximal runs of ink in row-major planes; ink tests the column `v`."""
    px = df.select(*keys, F.posexplode(plane).alias("p", "v")).where(ink if ink is not None else F.col("v") > 0)
    px = px.select(*keys, F.expr(f"p div {width}").cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"))
    island = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    return px.withColumn("_i", island).groupBy(*keys, "y", "_i").agg(F.min("x").alias("x_start"), (F.max("x") + 1).alias("x_end")).drop("_i")


def runs_plane(runs: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """keys, plane of 0 and 1; overlapping runs count once, parts beyond the plane are cut."""
    px = runs.where((F.col("y") >= 0) & (F.col("y") < height)).select(*keys, "y", F.greatest("x_start", F.lit(0)).alias("a"), F.least("x_end", F.lit(width)).alias("b")).where("b > a")
    px = px.select(*keys, F.explode(F.sequence(F.col("y") * width + F.col("a"), F.col("y") * width + F.col("b") - 1)).alias("p"))
    got = px.groupBy(*keys).agg(F.collect_set("p").alias("s"))
    return got.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda p: F.array_contains("s", p).cast("int")).alias("plane"))


def mask_get(plane: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """The sample at (x, y) of a row-major plane; 0 beyond it."""
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    return F.when(inside, F.try_element_at(plane, (y * width + x + 1).cast("int"))).otherwise(F.lit(0))


def adjacency(runs: DataFrame, keys: list[str], run_id: str) -> DataFrame:
    """a, b: runs of neighbouring rows that touch, corners included; an equi-join on the row."""
    up = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("x_start").alias("ps"), F.col("x_end").alias("pe"), F.col(run_id).alias("a"))
    down = runs.select(*keys, "y", F.col("x_start").alias("cs"), F.col("x_end").alias("ce"), F.col(run_id).alias("b"))
    return up.join(down, [*keys, "y"]).where("cs <= pe and ps <= ce").select("a", "b")


def run_components(runs: DataFrame, keys: list[str], run_id: str, min_area: int = 16) -> DataFrame:
    """keys, x, y, w, h, area, ox, oy of the 8-connected components with min_area pixels or more; the origin is the first run in scan order. run_id is unique and rises in scan order."""
    found = connected_components(adjacency(runs, keys, run_id), "a", "b").select(F.col("node").alias("_n"), "component")
    rows = runs.join(found, F.col(run_id) == F.col("_n"), "left").withColumn("_root", F.coalesce("component", run_id))
    box = rows.groupBy(*keys, "_root").agg(F.min("x_start").alias("x"), F.min("y").alias("y"), F.max("x_end").alias("_x1"), F.max("y").alias("_y1"), F.sum(F.col("x_end") - F.col("x_start")).alias("area"), F.min_by(F.struct(F.col("x_start").alias("ox"), F.col("y").alias("oy")), F.struct("y", "x_start")).alias("o"))
    return box.where(F.col("area") >= min_area).select(*keys, "x", "y", (F.col("_x1") - F.col("x")).alias("w"), (F.col("_y1") - F.col("y") + 1).alias("h"), "area", "o.ox", "o.oy")
