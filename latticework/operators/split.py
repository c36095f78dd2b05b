"""Splitting components that hold several icons: by depth seeds and flooding, or by bands at the thinnest columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .raster import chamfer, label, strongest_apart, watershed


@dataclass(frozen=True)
class SplitParams:
    # Defaults of the split.
    size: float = 2.2
    fat: float = 0.75
    apart: float = 0.6
    deep: float = 0.3
    sliver: float = 0.10
    most: int = 64
    rounds: int = 8
    band: int = 2


def component(mask: np.ndarray, box: tuple[int, int, int, int], origin: tuple[int, int]) -> np.ndarray:
    """The pixels of the mask inside the box (x, y, w, h) that are 8-connected to the origin (x, y) there."""
    x, y, w, h = box
    crop = mask[y : y + h, x : x + w]
    number = label(crop)
    own = number[origin[1] - y, origin[0] - x]
    return (number == own) & crop if own else np.zeros_like(crop)


def bands(ink: np.ndarray, k: int, least: int = 2) -> np.ndarray:
    """Labels from 1 of k bands across the longer side, each cut at the first thinnest line that leaves every band `least` wide."""
    wide = ink.shape[1] >= ink.shape[0]
    profile = ink.sum(axis=0 if wide else 1)
    cuts: list[int] = []
    for left in range(k - 1, 0, -1):
        lo, hi = (cuts[-1] if cuts else 0) + least, len(profile) - left * least
        if lo >= hi:
            break
        cuts.append(lo + int(np.argmin(profile[lo:hi])))
    number = 1 + np.searchsorted(np.array(cuts, dtype=int), np.arange(len(profile)), side="right")
    return np.where(ink, number[None, :] if wide else number[:, None], 0)


def contacts(labels: np.ndarray, own: int) -> dict[int, int]:
    """For each other label: how many neighbouring pixel pairs it has with `own`."""
    padded = np.pad(labels, 1)
    found = [np.zeros(0, dtype=labels.dtype)]
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            if (dy, dx) != (1, 1):
                near = padded[dy : dy + labels.shape[0], dx : dx + labels.shape[1]]
                found.append(near[(labels == own) & (near > 0) & (near != own)])
    number, count = np.unique(np.concatenate(found), return_counts=True)
    return dict(zip(number.tolist(), count.tolist()))


def reattach(labels: np.ndarray, p: SplitParams = SplitParams()) -> np.ndarray:
    """Regions far smaller than the mean join the neighbour they touch most (ties: the lowest label), until none is left."""
    labels = labels.copy()
    total = int((labels > 0).sum())
    for _ in range(p.rounds):
        number, area = np.unique(labels[labels > 0], return_counts=True)
        small = number[area < p.sliver * total / len(number)] if len(number) > 1 else []
        if not len(small):
            break
        for own in small:
            if near := contacts(labels, int(own)):
                labels[labels == own] = min(near, key=lambda n: (-near[n], n))
    return labels


def split(ink: np.ndarray, median_h: float, p: SplitParams = SplitParams()) -> np.ndarray | None:
    """Labels from 1 of a component's regions, or None: it is one icon, or nothing tells where to cut."""
    if not ink.any() or median_h <= 0:
        return None
    depth = np.where(ink, chamfer(ink, padded=True), 0)
    if depth.max() > p.fat * median_h:
        return None
    seeds = strongest_apart(np.where(depth >= p.deep * median_h, depth, 0), max(p.apart * median_h, 1.0), p.most)
    expected = min(max(int(ink.size / median_h**2 + 0.5), 1), p.most)
    if len(seeds) < 2 and expected >= 2:
        labels = bands(ink, expected, p.band)
    else:
        seeds = seeds[:expected]
        if len(seeds) < 2:
            return None
        labels = watershed(ink, seeds)
    labels = reattach(labels, p)
    return labels if len(np.unique(labels[labels > 0])) >= 2 else None


def regions(labels: np.ndarray, x0: int, y0: int) -> list[dict]:
    """Box, area and first pixel in scan order of each label, in (y, x) order."""
    out = []
    for number in np.unique(labels[labels > 0]):
        ys, xs = np.nonzero(labels == number)
        out.append({"x": x0 + int(xs.min()), "y": y0 + int(ys.min()), "w": int(np.ptp(xs)) + 1, "h": int(np.ptp(ys)) + 1, "area": len(xs), "ox": x0 + int(xs[0]), "oy": y0 + int(ys[0])})
    return sorted(out, key=lambda r: (r["y"], r["x"], r["oy"], r["ox"]))


def split_groups(groups: DataFrame, masks: DataFrame, keys: list[str], width: int, median_h: str, forced: bool = False, p: SplitParams = SplitParams()) -> DataFrame:
    """keys, x, y, w, h, area, ox, oy: groups, those replaced by regions that split.

    groups has keys, the box, area, origin and its sheet's median height; masks
    has keys and `mask`, a row-major array of a sheet's samples (ink above 0).
    Without `forced` only boxes larger than (size * median)^2 are tried.
    """
    columns = ["x", "y", "w", "h", "area", "ox", "oy"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.select(*keys).schema)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                parts = None
                if r["mask"] is not None and (forced or r["w"] * r["h"] > (p.size * r[median_h]) ** 2):
                    mask = np.asarray(r["mask"]).reshape(-1, width) > 0
                    labels = split(component(mask, (r["x"], r["y"], r["w"], r["h"]), (r["ox"], r["oy"])), r[median_h], p)
                    parts = None if labels is None else regions(labels, r["x"], r["y"])
                rows += [{k: r[k] for k in keys} | part for part in parts or [{c: r[c] for c in columns}]]
            yield pd.DataFrame(rows, columns=[*keys, *columns])

    joined = groups.select(*keys, *columns, median_h).join(masks.select(*keys, "mask"), keys, "left")
    return joined.mapInPandas(run, f"{kept}, x int, y int, w int, h int, area long, ox int, oy int")
