"""Queries whose steps SQL can't express: kernels over planes and paths, and the grouping chain; tests hold them against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.simplify import simplify_path
from ..operators import editor as E
from ..operators import grouping as G
from ..operators import palette as A
from ..operators import raster as R
from ..operators import segment as M
from ..operators import split as K
from .catalogue import SHEET, SIDE, boxes, planes, t

KERNELS: dict = {}


def kernel(f):
    KERNELS[f.__name__] = f
    return f


def coloured(plane: np.ndarray) -> np.ndarray:
    """An 8x8 plane as pixels: the plane, its transpose and their mean as colours, clear where the plane is dark."""
    a = plane.astype(np.int64)
    return np.stack([a, a.T, (a + a.T) // 2, np.where(a < 60, 0, 255)], axis=2).astype(np.uint8)


@kernel
def group_all(spark: SparkSession, d: str) -> DataFrame:
    return G.group_all(boxes(spark, d), "sheet", "id", SIDE, SIDE)


@kernel
def group_confidence(spark: SparkSession, d: str) -> DataFrame:
    out = G.summary(G.group_all(boxes(spark, d), "sheet", "id", SIDE, SIDE), "sheet", "id", SIDE, SIDE)
    return out.select("sheet", "n", *[S.round6(c).alias(c) for c in out.columns if c not in ("sheet", "n")])


@kernel
def plane_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Ink box, area, centroid, stroke, solidity, holes and components of each plane's ink."""

    def run(plane):
        ink = plane >= 128
        return {**R.metrics(ink), "holes": R.holes(ink), "parts": int(R.label(ink).max())}

    return R.per_plane(planes(spark, d), ["vec_id"], "u", 8, run, "x int, y int, w int, h int, area int, cx double, cy double, stroke double, solidity double, holes int, parts int")


@kernel
def plane_hausdorff(spark: SparkSession, d: str) -> DataFrame:
    """Each plane's ink against its mirror image."""
    return R.per_plane(planes(spark, d), ["vec_id"], "u", 8, lambda p: {"apart": R.hausdorff(p >= 128, p[:, ::-1] >= 128)}, "apart double")


@kernel
def plane_segments(spark: SparkSession, d: str) -> DataFrame:
    """The background that each coloured plane has, and its cleaned ink."""

    def run(plane):
        ink, bg = M.segment(coloured(plane))
        return {"kind": bg.kind, "red": bg.rgba[0], "green": bg.rgba[1], "blue": bg.rgba[2], "consensus": bg.consensus, "ink": int(ink.sum())}

    return R.per_plane(planes(spark, d), ["vec_id"], "u", 8, run, "kind string, red int, green int, blue int, consensus double, ink int")


@kernel
def plane_layers(spark: SparkSession, d: str) -> DataFrame:
    """How many paint layers each coloured plane has, and the largest one."""

    def run(plane):
        found = A.layers(coloured(plane), 4)
        return {"layers": len(found), "area": found[0]["area"] if found else 0, "paint": ",".join(map(str, found[0]["rgba"])) if found else ""}

    return R.per_plane(planes(spark, d), ["vec_id"], "u", 8, run, "layers int, area int, paint string")


@kernel
def plane_split(spark: SparkSession, d: str) -> DataFrame:
    """The groups of each plane's ink, those split that hold several icons of three pixels."""
    p = planes(spark, d).select("vec_id", F.transform("u", lambda v: (v >= 128).cast("int")).alias("mask"))

    def run(plane):
        number = R.label(plane > 0)
        found = [K.regions(number == n, 0, 0)[0] for n in range(1, int(number.max()) + 1)]
        return {"found": found}

    parts = R.per_plane(p, ["vec_id"], "mask", 8, run, "found array<struct<x:int,y:int,w:int,h:int,area:bigint,ox:int,oy:int>>")
    groups = parts.select("vec_id", F.inline("found")).withColumn("median_h", F.lit(3.0))
    return K.split_groups(groups, p, ["vec_id"], 8, "median_h")


@kernel
def path_simplify(spark: SparkSession, d: str) -> DataFrame:
    """Each plane's samples as a path, with fewer points."""
    from ..functions.svg import mapped

    points = F.transform("u", lambda v, i: F.concat(F.when(i == 0, "M").otherwise("L"), i.cast("string"), F.lit(" "), F.floor(v / 16).cast("string")))
    return planes(spark, d).select("vec_id", F.array_join(points, "").alias("path")).select("vec_id", mapped(simplify_path, F.col("path")).alias("path"))


@kernel
def edit_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps of editing sessions: sign-ups undo, purchases redo."""
    e = t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.expr("case event_type when 'signup' then 'undo' when 'purchase' then 'redo' else 'push' end").alias("step"))
    return E.history(e, "user_id", ["at", "event_id"], "step").select("user_id", "event_id", "depth", "stands")
