"""Editing commands over documents of nodes, as DataFrame operations.

A node row has doc, node (unique), z (draw order), x, y, w, h (bounds in the
document), grp (group or null), fill, visible and m, its affine matrix
(a, b, c, d, e, f).  A selection is a DataFrame of doc, node; every command
returns the documents with the selected nodes changed.  Bounds follow
translations and scalings; a rotated node's bounds are those of its turned box.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ["doc", "node", "z", "x", "y", "w", "h", "grp", "fill", "visible", "m"]
# Guides by how concrete they are, the first of equals wins.
PRIORITY = ["object", "centre", "canvas", "grid"]


def _marked(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    chosen = selection.select("doc", "node").distinct().withColumn("on", F.lit(True))
    return nodes.join(chosen, ["doc", "node"], "left").withColumn("on", F.coalesce("on", F.lit(False)))


def _changed(nodes: DataFrame, selection: DataFrame, changes: dict[str, Column]) -> DataFrame:
    rows = _marked(nodes, selection)
    return rows.withColumns({c: F.when(F.col("on"), v).otherwise(F.col(c)) for c, v in changes.items()}).select(*NODE)


def bounds(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    """doc, x0, y0, x1, y1 around the selected nodes."""
    rows = nodes.join(selection.select("doc", "node").distinct(), ["doc", "node"], "left_semi")
    return rows.groupBy("doc").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def _affine(by: list[Column]) -> Column:
    """The matrix `by` applied after the node's own."""
    a, b, c, d, e, f = by
    m = [F.col("m")[k] for k in range(6)]
    return F.array(a * m[0] + c * m[1], b * m[0] + d * m[1], a * m[2] + c * m[3], b * m[2] + d * m[3], a * m[4] + c * m[5] + e, b * m[4] + d * m[5] + f)


def translate(nodes: DataFrame, selection: DataFrame, dx: float, dy: float) -> DataFrame:
    if not dx and not dy:
        raise ValueError("a move by nothing")
    one, zero = F.lit(1.0), F.lit(0.0)
    return _changed(nodes, selection, {"m": _affine([one, zero, zero, one, F.lit(float(dx)), F.lit(float(dy))]), "x": F.col("x") + dx, "y": F.col("y") + dy})


def scale(nodes: DataFrame, selection: DataFrame, sx: float, sy: float, pivot: tuple[float, float]) -> DataFrame:
    """By a factor for each axis about a point that stays."""
    if sx <= 0 or sy <= 0 or (sx, sy) == (1, 1):
        raise ValueError("factors are positive and change something")
    px, py = pivot
    zero = F.lit(0.0)
    by = [F.lit(float(sx)), zero, zero, F.lit(float(sy)), F.lit(float(px - sx * px)), F.lit(float(py - sy * py))]
    return _changed(nodes, selection, {"m": _affine(by), "x": px + (F.col("x") - px) * sx, "y": py + (F.col("y") - py) * sy, "w": F.col("w") * sx, "h": F.col("h") * sy})


def rotate(nodes: DataFrame, selection: DataFrame, degrees: float, pivot: tuple[float, float]) -> DataFrame:
    """Clockwise in a document whose y axis points down, about a point that stays."""
    if not degrees % 360:
        raise ValueError("a turn by nothing")
    # right angles are exact
    quarter = degrees % 360 / 90
    cos, sin = ((1, 0), (0, 1), (-1, 0), (0, -1))[int(quarter)] if quarter == int(quarter) else (math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))
    px, py = pivot
    by = [F.lit(float(v)) for v in (cos, sin, -sin, cos, px - cos * px + sin * py, py - sin * px - cos * py)]
    cx, cy = F.col("x") + F.col("w") / 2 - px, F.col("y") + F.col("h") / 2 - py
    w, h = abs(cos) * F.col("w") + abs(sin) * F.col("h"), abs(sin) * F.col("w") + abs(cos) * F.col("h")
    return _changed(nodes, selection, {"m": _affine(by), "x": px + cos * cx - sin * cy - w / 2, "y": py + sin * cx + cos * cy - h / 2, "w": w, "h": h})


def _shift(nodes: DataFrame, selection: DataFrame, moves: DataFrame) -> DataFrame:
    """Selected nodes moved by their document's dx, dy."""
    rows = _marked(nodes, selection).join(moves, "doc", "left")
    dx, dy = (F.when(F.col("on"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)) for c in ("dx", "dy"))
    one, zero = F.lit(1.0), F.lit(0.0)
    return rows.withColumns({"m": _affine([one, zero, zero, one, dx, dy]), "x": F.col("x") + dx, "y": F.col("y") + dy}).select(*NODE)


def centre_on_canvas(nodes: DataFrame, selection: DataFrame, width: float, height: float) -> DataFrame:
    box = bounds(nodes, selection)
    return _shift(nodes, selection, box.select("doc", (width / 2 - (F.col("x0") + F.col("x1")) / 2).alias("dx"), (height / 2 - (F.col("y0") + F.col("y1")) / 2).alias("dy")))


def align(nodes: DataFrame, selection: DataFrame, edge: str, canvas: tuple[float, float] | None = None) -> DataFrame:
    """Each selected node's edge (left, hcentre, right, top, vcentre, bottom) on that of the selection's box or of the canvas."""
    share = {"left": 0.0, "hcentre": 0.5, "right": 1.0, "top": 0.0, "vcentre": 0.5, "bottom": 1.0}[edge]
    at, size, lo, hi = ("x", "w", "x0", "x1") if edge in ("left", "hcentre", "right") else ("y", "h", "y0", "y1")
    if canvas is None:
        box = bounds(nodes, selection).select("doc", (F.col(lo) + (F.col(hi) - F.col(lo)) * share).alias("line"))
    else:
        box = selection.select("doc").distinct().withColumn("line", F.lit(canvas[0 if at == "x" else 1] * share))
    rows = _marked(nodes, selection).join(box, "doc", "left")
    d = F.when(F.col("on"), F.col("line") - F.col(at) - F.col(size) * share).otherwise(F.lit(0.0))
    one, zero = F.lit(1.0), F.lit(0.0)
    move = [one, zero, zero, one, d, zero] if at == "x" else [one, zero, zero, one, zero, d]
    return rows.withColumns({"m": _affine(move), at: F.col(at) + d}).select(*NODE)


def set_fill(nodes: DataFrame, selection: DataFrame, fill: str) -> DataFrame:
    return _changed(nodes, selection, {"fill": F.lit(fill)})


def set_visible(nodes: DataFrame, selection: DataFrame, visible: bool) -> DataFrame:
    return _changed(nodes, selection, {"visible": F.lit(visible)})


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.withColumn("z", (F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1).cast("int")).select(*NODE)


def arrange(nodes: DataFrame, selection: DataFrame, front: bool) -> DataFrame:
    """The selection on top of all other nodes, or under them, in its own order."""
    rows = _marked(nodes, selection)
    return _ranked(rows, F.col("on") if front else ~F.col("on"), "z", "node")


def reorder(nodes: DataFrame, selection: DataFrame, up: bool) -> DataFrame:
    """Each run of selected neighbours one step up or down; a run at the end stays."""
    rows = _marked(nodes, selection).withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy("z", "node")) - 1)
    w = Window.partitionBy("doc").orderBy("at" if up else F.desc("at"))
    # a node that isn't selected steps over the run of selected ones before it
    run = F.sum((~F.col("on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.coalesce(run, F.lit(0)))
    length = F.sum(F.col("on").cast("int")).over(Window.partitionBy("doc", "run"))
    over = F.max((~F.col("on")).cast("int")).over(Window.partitionBy("doc", "run")) == 1
    step = F.lit(1 if up else -1)
    place = F.when(F.col("on"), F.when(over, F.col("at") + step).otherwise(F.col("at"))).otherwise(F.col("at") - step * length)
    return rows.withColumn("z", place.cast("int")).select(*NODE)


def duplicate(nodes: DataFrame, selection: DataFrame, dx: float, dy: float) -> DataFrame:
    """Copies of the selected nodes on top, moved; their ids follow the document's largest."""
    rows = _marked(nodes, selection)
    top = nodes.groupBy("doc").agg(F.max("z").alias("top"), F.max("node").alias("last"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("z", "node"))
    copies = rows.where("on").drop("on").withColumn("n", n).join(top, "doc")
    copies = copies.withColumns({"node": F.col("last") + F.col("n"), "z": (F.col("top") + F.col("n")).cast("int"), "x": F.col("x") + dx, "y": F.col("y") + dy})
    one, zero = F.lit(1.0), F.lit(0.0)
    copies = copies.withColumn("m", _affine([one, zero, zero, one, F.lit(float(dx)), F.lit(float(dy))]))
    return nodes.select(*NODE).unionByName(copies.select(*NODE))


def delete(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    return nodes.join(selection.select("doc", "node"), ["doc", "node"], "left_anti").select(*NODE)


def group(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    """The selection as one new group, numbered after the document's largest."""
    new = nodes.groupBy("doc").agg((F.coalesce(F.max("grp"), F.lit(0)) + 1).alias("new"))
    rows = _marked(nodes, selection).join(new, "doc")
    return rows.withColumn("grp", F.when(F.col("on"), F.col("new")).otherwise(F.col("grp"))).select(*NODE)


def ungroup(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    """The groups of the selected nodes dissolved, for all their members."""
    gone = _marked(nodes, selection).where("on and grp is not null").select("doc", "grp").distinct().withColumn("gone", F.lit(True))
    rows = nodes.join(gone, ["doc", "grp"], "left")
    return rows.withColumn("grp", F.when(F.col("gone"), F.lit(None)).otherwise(F.col("grp"))).select(*NODE)


def expand(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    """doc, node of the selection and of all members of its groups."""
    chosen = nodes.join(selection.select("doc", "node").distinct(), ["doc", "node"], "left_semi")
    groups = chosen.where("grp is not null").select("doc", "grp").distinct()
    members = nodes.join(groups, ["doc", "grp"], "left_semi").select("doc", "node")
    return chosen.select("doc", "node").unionByName(members).distinct()


def select_add(nodes: DataFrame, selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.select("doc", "node").unionByName(expand(nodes, more)).distinct()


def select_remove(selection: DataFrame, less: DataFrame) -> DataFrame:
    return selection.select("doc", "node").join(less.select("doc", "node"), ["doc", "node"], "left_anti").distinct()


def select_toggle(selection: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is in one of both: chosen nodes leave, others come."""
    both = selection.select("doc", "node").distinct().unionByName(nodes.select("doc", "node").distinct())
    return both.groupBy("doc", "node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc", "node")


def hit_test(nodes: DataFrame, px: float, py: float, tolerance: float = 0.0) -> DataFrame:
    """doc, node: the topmost visible node whose box, grown by the tolerance, holds the point."""
    inside = (F.col("x") - tolerance <= px) & (F.col("x") + F.col("w") + tolerance >= px) & (F.col("y") - tolerance <= py) & (F.col("y") + F.col("h") + tolerance >= py)
    return nodes.where(F.col("visible") & inside).groupBy("doc").agg(F.max_by("node", F.struct("z", "node")).alias("node"))


def marquee(nodes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """doc, node of the visible nodes whose box meets the rectangle, borders included; corners in any order."""
    (x0, x1), (y0, y1) = sorted((x0, x1)), sorted((y0, y1))
    meets = (F.col("x") + F.col("w") >= x0) & (F.col("x") <= x1) & (F.col("y") + F.col("h") >= y0) & (F.col("y") <= y1)
    return nodes.where(F.col("visible") & meets).select("doc", "node")


def snap(nodes: DataFrame, selection: DataFrame, dx: float, dy: float, width: float, height: float, grid: float = 0.0, tolerance: float = 6.0) -> DataFrame:
    """doc, dx, dy of a move whose box snaps, axis by axis, to the nearest edge or centre of other visible nodes, the canvas or a grid.

    Of corrections equally small the most concrete target wins, then the first
    of low edge, centre and high edge.
    """
    box = bounds(nodes, selection)
    others = _marked(nodes, selection).where("not on and visible")
    out = box.select("doc")
    for axis, lo, hi, at, size, d, length in (("x", "x0", "x1", "x", "w", dx, width), ("y", "y0", "y1", "y", "h", dy, height)):
        kinds = [("object", F.col(at)), ("centre", F.col(at) + F.col(size) / 2), ("object", F.col(at) + F.col(size))]
        lines = others.select("doc", F.explode(F.array(*[F.struct(F.lit(PRIORITY.index(k)).alias("kind"), v.cast("double").alias("line")) for k, v in kinds])).alias("t")).select("doc", "t.*")
        fixed = [("canvas", v) for v in (0.0, length / 2, length)] + [("grid", k * grid) for k in range(int(length // grid) + 1) if grid > 0]
        fixed_lines = F.explode(F.array(*[F.struct(F.lit(PRIORITY.index(k)).alias("kind"), F.lit(float(v)).alias("line")) for k, v in fixed]))
        lines = lines.unionByName(box.select("doc", fixed_lines.alias("t")).select("doc", "t.*"))
        edges = F.array(*[F.struct(F.lit(k).alias("edge"), (v + d).alias("pos")) for k, v in enumerate((F.col(lo), (F.col(lo) + F.col(hi)) / 2, F.col(hi)))])
        moved = box.select("doc", F.explode(edges).alias("e")).select("doc", "e.*")
        offers = lines.join(moved, "doc").withColumn("by", F.col("line") - F.col("pos")).where(F.abs("by") <= tolerance)
        best = offers.groupBy("doc").agg(F.min_by("by", F.struct(F.abs("by"), "kind", "edge", "line")).alias(f"by_{axis}"))
        out = out.join(best, "doc", "left").withColumn(f"d{axis}", d + F.coalesce(f"by_{axis}", F.lit(0.0))).drop(f"by_{axis}")
    return out


def history(events: DataFrame, session: str, order: list[str], kind: str, most: int = 256) -> DataFrame:
    """events with depth (steps that stand) and stands, after pushes, undos and redos.

    A push drops undone steps and beyond `most` steps the oldest; an undo or redo
    with nothing left does nothing.  The fold is sequential, so a session's
    events are one group; sessions are as long as a person's editing.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def fold(rows):
        rows = rows.sort_values(order)
        done, undone, depth, of = [], [], [], {}
        for at, k in zip(rows.index, rows[kind]):
            if k == "undo":
                if done:
                    undone.append(done.pop())
            elif k == "redo":
                if undone:
                    done.append(undone.pop())
            else:
                undone.clear()
                done.append(at)
                del done[:-most]
            depth.append(len(done))
        of = set(done)
        return rows.assign(depth=depth, stands=[i in of for i in rows.index])

    return events.groupBy(session).applyInPandas(fold, f"{kept}, depth int, stands boolean")
