"""Sheet-relative leveling of icons, and the grid they are laid out on."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .robust import cv

# Exponent and clamp of the stroke correction, slope and clamp of the solidity correction, flag bits.
STROKE_POWER, STROKE_CLAMP, SOLID_SLOPE, SOLID_CLAMP = 0.35, (0.88, 1.12), 0.06, (0.96, 1.04)
OVERFLOW, STROKE_CLAMPED, SOLIDITY_CLAMPED = 1, 2, 4


@dataclass(frozen=True)
class SheetSpec:
    cell: int = 64
    padding: int = 8
    gap: int = 8
    margin: int = 8
    columns: int = 16
    ink_ratio: float = 0.80
    placement: str = "center"  # or "optical", "baseline"

    def clamped(self) -> SheetSpec:
        """Values moved into their ranges; a ratio that is no number becomes the default."""
        cell = min(4096, max(8, self.cell))
        ratio = 0.8 if self.ink_ratio != self.ink_ratio else min(1.0, max(0.05, self.ink_ratio))
        return SheetSpec(cell, min(max(0, self.padding), cell // 2), min(4096, max(0, self.gap)), min(4096, max(0, self.margin)), min(4096, max(1, self.columns)), ratio, self.placement)


def fit_columns(width: float, spec: SheetSpec) -> int:
    """Columns that fit a width; 1 where not even one does."""
    if not (width == width and width < float("inf")) or width < spec.cell:
        return 1
    return max(1, int((width - 2 * spec.margin + spec.gap) // (spec.cell + spec.gap)))


def grid_layout(df: DataFrame, sheet: str, order: list[str], spec: SheetSpec) -> DataFrame:
    """df with index, col, row, cell_x, cell_y by reading order in each sheet."""
    w = Window.partitionBy(sheet).orderBy(*order)
    out = df.withColumn("index", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(sheet)))
    columns = F.least(F.lit(spec.columns), "n")
    out = out.withColumn("col", (F.col("index") % columns).cast("int")).withColumn("row", F.floor(F.col("index") / columns).cast("int"))
    step = spec.cell + spec.gap
    return out.withColumn("cell_x", F.col("col") * step + spec.margin).withColumn("cell_y", F.col("row") * step + spec.margin)


def sheet_size(df: DataFrame, sheet: str, spec: SheetSpec) -> DataFrame:
    """sheet, n, columns, rows, width, height."""
    size = df.groupBy(sheet).agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.least(F.lit(spec.columns), "n").cast("int"))
    size = size.withColumn("rows", F.ceil(F.col("n") / F.col("columns")).cast("int"))
    side = lambda c: F.col(c) * spec.cell + (F.col(c) - 1) * spec.gap + 2 * spec.margin
    return size.withColumn("width", side("columns")).withColumn("height", side("rows"))


def grid_position(number: Column, columns: int) -> Column:
    """struct(row, col), both from 1, of a 1-based number; 0 columns count as 1."""
    c = max(1, columns)
    return F.struct((F.floor((number - 1) / c) + 1).cast("int").alias("row"), ((number - 1) % c + 1).cast("int").alias("col"))


def _clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def level(laid: DataFrame, sheet: str, spec: SheetSpec) -> DataFrame:
    """laid (with ink_w, ink_h, stroke, solidity) with scale, x, y, out_w, out_h, flags: each icon against its sheet's medians.

    Icons stand centred in their cells; with placement "optical" they move by
    half the way from the ink box's centre to the centroid (columns ink_x, ink_y,
    cx, cy), with "baseline" their ink stands on the inner box's lower edge.
    """
    inner = spec.cell - 2 * spec.padding
    target = inner * spec.ink_ratio
    medians = laid.groupBy(sheet).agg(F.median("stroke").alias("_ms"), F.median("solidity").alias("_mo"))
    side = F.greatest("ink_w", "ink_h").cast("double")
    fit = target / side
    stroke = F.when((F.col("stroke") > 0) & (F.col("_ms") > 0), F.pow(F.col("_ms") / F.col("stroke"), STROKE_POWER)).otherwise(F.lit(1.0))
    solid = 1 + SOLID_SLOPE * (F.col("_mo") - F.col("solidity"))
    raw = fit * _clamp(stroke, *STROKE_CLAMP) * _clamp(solid, *SOLID_CLAMP)
    over = raw * side > inner
    scale = F.when(over, F.least(inner / side, fit)).otherwise(raw)
    bits = [(over, OVERFLOW), ((stroke < STROKE_CLAMP[0]) | (stroke > STROKE_CLAMP[1]), STROKE_CLAMPED), ((solid < SOLID_CLAMP[0]) | (solid > SOLID_CLAMP[1]), SOLIDITY_CLAMPED)]
    flags = reduce(lambda a, b: a + b, [F.when(c, bit).otherwise(0) for c, bit in bits])
    out = laid.join(medians, sheet).withColumn("scale", scale).withColumn("flags", flags).drop("_ms", "_mo")
    out = out.withColumn("out_w", F.col("ink_w") * F.col("scale")).withColumn("out_h", F.col("ink_h") * F.col("scale"))
    free = {k: F.greatest(inner - F.col(f"out_{k}"), F.lit(0.0)) for k in "wh"}
    shift = {"x": F.lit(0.0), "y": F.lit(0.0)}
    if spec.placement == "optical":
        shift = {k: (F.col(f"ink_{k}") + F.col(f"ink_{side}") / 2 - F.col(f"c{k}")) / 2 for k, side in (("x", "w"), ("y", "h"))}
    y = free["h"] if spec.placement == "baseline" else free["h"] / 2 + shift["y"]
    return out.withColumn("x", F.col("cell_x") + spec.padding + free["w"] / 2 + shift["x"]).withColumn("y", F.col("cell_y") + spec.padding + y)


def report(leveled: DataFrame, sheet: str) -> DataFrame:
    """sheet, ink_size_cv, stroke_cv (of the strokes as measured), baseline_spread (the worst grid row), and counts of the flags."""
    rows = leveled.groupBy(sheet, "row").agg((F.max(F.col("y") + F.col("out_h")) - F.min(F.col("y") + F.col("out_h"))).alias("s")).groupBy(sheet).agg(F.max("s").alias("baseline_spread"))
    sized = leveled.withColumn("_ink", F.greatest("out_w", "out_h"))
    count = lambda bit: F.sum((F.col("flags").bitwiseAND(F.lit(bit)) > 0).cast("int"))
    main = sized.groupBy(sheet).agg(cv("_ink").alias("ink_size_cv"), cv("stroke").alias("stroke_cv"), count(OVERFLOW).alias("overflows"), count(STROKE_CLAMPED).alias("stroke_clamped"), count(SOLIDITY_CLAMPED).alias("solidity_clamped"))
    return main.join(rows, sheet)
