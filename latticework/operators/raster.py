"""Kernels over single planes that are sequential by nature, in numpy, and their grouped Spark form.

Masks are boolean arrays [y, x]; luma planes are uint8.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# White point and matrix of sRGB to XYZ (D65), chamfer steps in thousandths.
D65 = (0.95047, 1.0, 1.08883)
RGB_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
STRAIGHT, DIAGONAL = 1000, 1414


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114


def srgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.float64) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = linear @ RGB_XYZ.T / np.array(D65)
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def delta_e76(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def _neighbours(mask: np.ndarray, outside: bool = False) -> np.ndarray:
    """Sum over each 3x3 neighbourhood; beyond the plane counts as `outside`."""
    p = np.pad(mask.astype(np.int32), 1, constant_values=int(outside))
    rows = p[:-2] + p[1:-1] + p[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def median3(mask: np.ndarray) -> np.ndarray:
    return _neighbours(mask) >= 5


def dilate(mask: np.ndarray) -> np.ndarray:
    return _neighbours(mask) > 0


def erode(mask: np.ndarray) -> np.ndarray:
    return _neighbours(mask) == 9


def opened(mask: np.ndarray) -> np.ndarray:
    return dilate(erode(mask))


def closed(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for step in (dilate, erode):
        for _ in range(times):
            mask = step(mask)
    return mask


def clean(mask: np.ndarray, passes: int = 1) -> np.ndarray:
    """Majority, open, then close at most twice."""
    return closed(opened(median3(mask)), min(passes, 2))


def chamfer(ink: np.ndarray, padded: bool = False) -> np.ndarray:
    """Two-pass distance to the nearest pixel without ink, in pixels; with `padded` the outside has none."""
    d = np.where(ink, np.int64(1) << 40, 0)
    if padded:
        d = np.pad(d, 1)
    h, w = d.shape
    steps = np.arange(w) * STRAIGHT
    for order in (range(h), range(h - 1, -1, -1)):
        last = None
        for y in order:
            row = d[y]
            if last is not None:
                row = np.minimum(row, last + STRAIGHT)
                row[1:] = np.minimum(row[1:], last[:-1] + DIAGONAL)
                row[:-1] = np.minimum(row[:-1], last[1:] + DIAGONAL)
            row = np.minimum.accumulate(row - steps) + steps
            row = (np.minimum.accumulate((row + steps)[::-1]))[::-1] - steps
            d[y] = last = row
    if padded:
        d = d[1:-1, 1:-1]
    return d / STRAIGHT


def inscribed_radius(ink: np.ndarray) -> float:
    """Largest distance of ink from what isn't; edges of the crop aren't background, an all-ink crop gives half its short side."""
    if not ink.any():
        return 0.0
    return min(ink.shape) / 2 if ink.all() else float(chamfer(ink).max())


def hausdorff(a: np.ndarray, b: np.ndarray) -> float | None:
    """Larger of both directed distances over the diagonal; None where a plane is blank."""
    if not a.any() or not b.any():
        return None
    far = max(chamfer(~b)[a].max(), chamfer(~a)[b].max())
    return float(far / np.hypot(*a.shape))


def hull_area(ink: np.ndarray) -> float | None:
    """Convex hull of ink pixel centres, grown to cover them: area + perimeter / 2 + 1; None under three corner points."""
    pts = []
    for y in np.flatnonzero(ink.any(axis=1)):
        xs = np.flatnonzero(ink[y])
        pts += [(int(xs[0]), int(y)), (int(xs[-1]), int(y))]
    pts = sorted(set(pts))
    if len(pts) < 3:
        return None

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(half(pts) + half(pts[::-1]), dtype=float)
    if len(hull) < 3:
        return None
    to = np.roll(hull, -1, axis=0)
    area = abs((hull[:, 0] * to[:, 1] - hull[:, 1] * to[:, 0]).sum()) / 2
    return float(area + np.hypot(*(to - hull).T).sum() / 2 + 1)


def solidity(ink: np.ndarray) -> float:
    hull = hull_area(ink)
    return 1.0 if hull is None else float(ink.sum() / hull)


def label(ink: np.ndarray) -> np.ndarray:
    """8-connected components numbered from 1 in scan order of their first pixel; 0 without ink."""
    h, w = ink.shape
    big = h * w + 1
    lab = np.where(ink, np.arange(1, h * w + 1).reshape(h, w), big)
    while True:
        p = np.pad(lab, 1, constant_values=big)
        low = np.minimum.reduce([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
        new = np.where(ink, np.minimum(lab, low), big)
        # jump to the label of the pixel that a label names
        flat = new.ravel()
        on = flat < big
        flat[on] = np.minimum(flat[on], flat[flat[on] - 1])
        new = flat.reshape(h, w)
        if (new == lab).all():
            break
        lab = new
    names = np.unique(lab[ink])
    return np.where(ink, np.searchsorted(names, lab) + 1, 0)


def holes(ink: np.ndarray) -> int:
    """Background pockets, 4-connected, that don't reach the border."""
    h, w = ink.shape
    free = np.pad(~ink, 1, constant_values=True)
    seen = np.zeros_like(free)
    count = -1  # the outside
    for y, x in zip(*np.nonzero(free)):
        if seen[y, x]:
            continue
        count += 1
        todo = [(y, x)]
        seen[y, x] = True
        while todo:
            v, u = todo.pop()
            for q, r in ((v - 1, u), (v + 1, u), (v, u - 1), (v, u + 1)):
                if 0 <= q < h + 2 and 0 <= r < w + 2 and free[q, r] and not seen[q, r]:
                    seen[q, r] = True
                    todo.append((q, r))
    return count


def kmeans_two(values: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Two integer centres after fixed Lloyd rounds, and each value's side (ties: the first).

    The seeds are the first value and the one farthest from it (ties: the largest).
    """
    v = values.astype(np.int64).reshape(len(values), -1)
    away = ((v - v[0]) ** 2).sum(axis=1)
    far = np.lexsort((*v.T[::-1], away))[-1]
    centres = np.stack([v[0], v[far]])
    side = np.zeros(len(v), dtype=np.int64)
    for _ in range(rounds):
        side = np.argmin(((v[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
        for k in (0, 1):
            if (side == k).any():
                centres[k] = v[side == k].sum(axis=0) // (side == k).sum()
    return centres, side


def strongest_apart(strength: np.ndarray, radius: float, most: int = 64) -> list[tuple[int, int]]:
    """Greedy (y, x) picks: strongest first (ties: scan order), each more than radius from all before."""
    flat = strength.ravel()
    kept: list[tuple[int, int]] = []
    for k in np.argsort(-flat, kind="stable"):
        if flat[k] <= 0 or len(kept) >= most:
            break
        y, x = divmod(int(k), strength.shape[1])
        if all((y - a) ** 2 + (x - b) ** 2 > radius * radius for a, b in kept):
            kept.append((y, x))
    return kept


def watershed(ink: np.ndarray, seeds: list[tuple[int, int]]) -> np.ndarray:
    """Each ink pixel's seed number (from 1): seeds grow from deep to shallow ink; ties by scan order."""
    import heapq

    depth = chamfer(ink, padded=True)
    out = np.zeros(ink.shape, dtype=np.int64)
    heap = []
    for n, (y, x) in enumerate(seeds, 1):
        if ink[y, x] and not out[y, x]:
            out[y, x] = n
            heap.append((-depth[y, x], y, x))
    heapq.heapify(heap)
    while heap:
        _, y, x = heapq.heappop(heap)
        for v in range(max(0, y - 1), min(ink.shape[0], y + 2)):
            for u in range(max(0, x - 1), min(ink.shape[1], x + 2)):
                if ink[v, u] and not out[v, u]:
                    out[v, u] = out[y, x]
                    heapq.heappush(heap, (-depth[v, u], v, u))
    return out


def block_ssim(a: np.ndarray, b: np.ndarray, side: int = 8) -> float:
    """Mean SSIM of side x side blocks, partial ones at the edges included."""
    from .planes import C1, C2

    scores = []
    for y in range(0, a.shape[0], side):
        for x in range(0, a.shape[1], side):
            p, q = a[y : y + side, x : x + side].astype(float), b[y : y + side, x : x + side].astype(float)
            mp, mq = p.mean(), q.mean()
            cov = ((p - mp) * (q - mq)).mean()
            scores.append(((2 * mp * mq + C1) * (2 * cov + C2)) / ((mp * mp + mq * mq + C1) * (p.var() + q.var() + C2)))
    return float(np.mean(scores))


def border_consensus(rgba: np.ndarray) -> tuple[tuple[int, int, int], float]:
    """Mean colour and share of the fullest 4-4-4-bit bin of the border ring (ties: lowest bin)."""
    ring = np.concatenate([rgba[0], rgba[-1], rgba[1:-1, 0], rgba[1:-1, -1]])[:, :3].astype(np.int64)
    bins = (ring[:, 0] >> 4) << 8 | (ring[:, 1] >> 4) << 4 | ring[:, 2] >> 4
    counts = np.bincount(bins, minlength=4096)
    top = int(counts.argmax())
    own = ring[bins == top]
    return tuple(int(c) for c in own.sum(axis=0) // len(own)), float(counts[top] / len(ring))


def normalise_plane(gray: np.ndarray, size: int = 64) -> np.ndarray:
    """Ink (samples of 128 and more) fitted into size x size by its longest side, centred, by box averages of a doubled plane."""
    ink = gray >= 128
    if not ink.any():
        return np.zeros((size, size), dtype=np.uint8)
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    crop = gray[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    longest, n = max(crop.shape), 2 * size
    h, w = (max(1, round(s * n / longest)) for s in crop.shape)
    fine = crop[np.arange(h) * crop.shape[0] // h][:, np.arange(w) * crop.shape[1] // w]
    canvas = np.zeros((n, n), dtype=np.int64)
    y, x = (n - h) // 2, (n - w) // 2
    canvas[y : y + h, x : x + w] = fine
    sums = canvas.reshape(size, 2, size, 2).sum(axis=(1, 3))
    return ((2 * sums + 4) // 8).astype(np.uint8)


def metrics(ink: np.ndarray) -> dict[str, float]:
    """Ink box, area, centroid, stroke (twice the inscribed radius) and solidity."""
    if not ink.any():
        return {"x": 0, "y": 0, "w": 0, "h": 0, "area": 0, "cx": 0.0, "cy": 0.0, "stroke": 0.0, "solidity": 1.0}
    ys, xs = np.nonzero(ink)
    return {"x": int(xs.min()), "y": int(ys.min()), "w": int(xs.max() - xs.min() + 1), "h": int(ys.max() - ys.min() + 1), "area": int(ink.sum()), "cx": float(xs.mean()), "cy": float(ys.mean()), "stroke": 2 * inscribed_radius(ink), "solidity": solidity(ink)}


def per_plane(df: DataFrame, keys: list[str], plane: str, width: int, kernel: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """keys and the kernel's columns for each row's plane (an array column, row-major); one pass, no shuffle."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches):
        for b in batches:
            rows = [kernel(np.asarray(p).reshape(-1, width)) for p in b[plane]]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return df.select(*keys, plane).mapInPandas(run, f"{kept}, {schema}")
