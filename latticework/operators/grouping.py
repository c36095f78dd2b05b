"""The grouping of a sheet from components to icons: filters, merge passes, the grid's corrections, confidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boxes as B
from . import confidence as C
from . import lattice as L
from .graph import checkpoint

#: What a caller may put in place of a step: both take and return tables of boxes.
Masker = Callable[[DataFrame], DataFrame]
Grouper = Callable[[DataFrame], DataFrame]

# The knobs' names with their least and largest values, and what the grid step needs.
RANGES = {"merge_gap_frac": (0.05, 1.0), "merge_area_ratio": (1.0, 8.0), "noise_min_area": (0, 512), "grid_regularity_min": (0.0, 1.0)}
REGULAR, CELLS, MOST = 0.75, 1.5, 64


@dataclass(frozen=True)
class Sensitivity:
    merge_gap_frac: float = 0.35
    merge_area_ratio: float = 1.75
    noise_min_area: int = 16
    grid_regularity_min: float = REGULAR

    def params(self) -> B.MergeParams:
        """Merge parameters with the knobs' values; one out of its range is refused."""
        for name, (lo, hi) in RANGES.items():
            if not lo <= getattr(self, name) <= hi:  # nor a value that is no number
                raise ValueError(f"{name} {getattr(self, name)} outside [{lo}, {hi}]")
        return B.MergeParams(gap_factor=self.merge_gap_frac, band_area=self.merge_area_ratio, area=self.noise_min_area)

    def clamped(self) -> Sensitivity:
        """Values moved into their ranges; one that is no number becomes the least."""
        fit = lambda v, lo, hi: lo if v != v or v in (float("inf"), float("-inf")) else min(hi, max(lo, v))
        return Sensitivity(**{k: fit(getattr(self, k), *r) for k, r in RANGES.items()})


def merged(boxes: DataFrame, sheet: str, item: str, p: B.MergeParams = B.MergeParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups after up to p.passes passes, (origin, root) of every box, and the stats that all passes go by.

    Heights, areas and the gap are those of the boxes before the first pass; a
    pass that joins nothing is the last.
    """
    area = F.col("area") if "area" in boxes.columns else F.col("w").cast("long") * F.col("h")
    now = checkpoint(boxes.select(sheet, item, "x", "y", "w", "h", area.cast("long").alias("area"), F.lit(1).cast("long").alias("members")))
    stats = checkpoint(B.merge_stats(now, sheet, p))
    roots = now.select(F.col(item).alias("origin"), F.col(item).alias("root"))
    for _ in range(p.passes):
        links = checkpoint(B.merge_pairs(now, sheet, item, p, stats).where(F.col("rule").startswith("R")).select("a", "b"))
        if links.isEmpty():
            break
        found = B.connected_components(links, "a", "b").select(F.col("node").alias("n"), "component")
        roots = checkpoint(roots.join(found, F.col("root") == F.col("n"), "left").select("origin", F.coalesce("component", "root").alias("root")))
        now = checkpoint(B.united(now, links, sheet, item))
    return now, roots, stats


def grid(boxes: DataFrame, sheet: str, regular: float = REGULAR) -> tuple[DataFrame, DataFrame]:
    """The valleys of both axes, of sheets whose axis is regular enough to be a grid."""
    out = []
    for at, size, weight in (("x", "w", "h"), ("y", "h", "w")):
        found = checkpoint(L.valleys(L.profile(boxes, sheet, at, size, weight), sheet))
        sure = L.regularity(found, sheet).where(F.col("regularity") >= regular).select(sheet)
        out.append(found.join(sure, sheet, "left_semi"))
    return out[0], out[1]


def group_all(boxes: DataFrame, sheet: str, item: str, width: int, height: int, s: Sensitivity = Sensitivity()) -> DataFrame:
    """sheet, item, x, y, w, h, area, members, axes, restored: the groups of every sheet.

    Boxes that are noise go; what is left merges.  Where a grid shows, groups of
    two boxes or more that lie across a valley are taken apart again: their boxes
    come back, marked.  axes tells which valleys a group lies across.
    """
    p = s.params()
    kept = checkpoint(B.noise_filter(boxes, sheet, width, height, p))
    groups, roots, stats = merged(kept, sheet, item, p)
    x, y = grid(kept, sheet, s.grid_regularity_min)
    judged = checkpoint(L.classify(groups, x, y, sheet).join(stats.select(sheet, "mh"), sheet))
    wrong = (F.col("axes") > 0) & (F.col("members") > 1) & (F.col("w").cast("long") * F.col("h") >= F.floor(CELLS * F.col("mh") * F.col("mh") + 0.5))
    gone = judged.where(wrong).select(F.col(item).alias("gone"))
    columns = [sheet, item, "x", "y", "w", "h", "area", "members", "axes"]
    stay = judged.where(~wrong).select(*columns, F.lit(False).alias("restored"))
    area = F.col("area") if "area" in kept.columns else F.col("w").cast("long") * F.col("h")
    back = kept.join(roots.join(gone, F.col("root") == F.col("gone")).select("origin"), F.col(item) == F.col("origin"))
    back = L.classify(back.select(sheet, item, "x", "y", "w", "h", area.cast("long").alias("area"), F.lit(1).cast("long").alias("members")), x, y, sheet)
    return stay.unionByName(back.select(*columns, F.lit(True).alias("restored")))


def across(groups: DataFrame, sheet: str, order: list[str], most: int = MOST) -> DataFrame:
    """Of each sheet's groups of one box that lie across a valley, the first `most`: those to split by force."""
    w = Window.partitionBy(sheet).orderBy(*order)
    rows = groups.where("axes > 0 and members = 1").withColumn("_n", F.row_number().over(w))
    return rows.where(F.col("_n") <= most).drop("_n")


def summary(groups: DataFrame, sheet: str, item: str, width: int, height: int, background: DataFrame | None = None) -> DataFrame:
    """sheet, n, the six signals and the score of final groups; background: sheet, consensus, kind."""
    n_merges = F.sum(F.when(~F.col("restored"), F.col("members") - 1).otherwise(0)).alias("merges")
    ev = groups.groupBy(sheet).agg(n_merges, F.sum(((F.col("axes") > 0) | F.col("restored")).cast("int")).alias("warnings"))
    none = {"reg_x": "double", "reg_y": "double", "n_x": "int", "n_y": "int"}
    ev = ev.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    if background is None:
        ev = ev.withColumns({"consensus": F.lit(None).cast("double"), "kind": F.lit(None).cast("string")})
    else:
        ev = ev.join(background.select(sheet, "consensus", "kind"), sheet, "left")
    return C.score(groups, sheet, width, height, ev)


def scan_order(groups: DataFrame, sheet: str) -> DataFrame:
    """groups with place: their number from 0 in (y, x, origin) order on the sheet."""
    ties = [c for c in ("ox", "oy", "id") if c in groups.columns]
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(sheet).orderBy("y", "x", *ties)) - 1)


def truth_matches(groups: DataFrame, truth: DataFrame, sheet: str, item: str, near: int = 1, size: int = 2) -> DataFrame:
    """sheet, truth, found, coverage: pairs of a true box and a group within `near` pixels in place and `size` in each side.

    An equi-join on places: each true box asks for its own place and those around it.
    """
    around = F.explode(F.sequence(F.lit(-near), F.lit(near)))
    t = truth.select(sheet, F.col(item).alias("truth"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("w").alias("tw"), F.col("h").alias("th")).withColumn("dx", around).withColumn("dy", around)
    t = t.withColumns({"x": F.col("tx") + F.col("dx"), "y": F.col("ty") + F.col("dy")})
    pairs = t.join(groups.select(sheet, F.col(item).alias("found"), "x", "y", "w", "h"), [sheet, "x", "y"]).where((F.abs(F.col("w") - F.col("tw")) <= size) & (F.abs(F.col("h") - F.col("th")) <= size))
    over = lambda a, s, b, u: F.greatest(F.lit(0), F.least(F.col(a) + F.col(s), F.col(b) + F.col(u)) - F.greatest(a, b))
    share = over("x", "w", "tx", "tw") * over("y", "h", "ty", "th") / (F.col("tw") * F.col("th"))
    return pairs.select(sheet, "truth", "found", share.alias("coverage"))
