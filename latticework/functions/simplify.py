"""Straight-line paths with fewer points: corners are held, then collinear, near and small-triangle points go."""

from __future__ import annotations

import math

from .svg import Point, parse_path, segment_distance, simplify, write_path

# Degrees that make a corner and that count as straight, the distance and area limits, and the grid that points move to.
CORNER, STRAIGHT, NEAR, AREA, GRID = 60.0, 0.5, 0.35, 0.4, 0.15


def turn(a: Point, b: Point, c: Point) -> float:
    """Degrees by which the way a, b, c departs from straight."""
    p, q = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
    n = math.hypot(*p) * math.hypot(*q)
    return math.degrees(math.acos(max(-1.0, min(1.0, (p[0] * q[0] + p[1] * q[1]) / n)))) if n else 0.0


def corners(points: list[Point], degrees: float = CORNER) -> list[bool]:
    """Points that stay: both ends, and inner ones with a turn of `degrees` or more."""
    return [k in (0, len(points) - 1) or turn(points[k - 1], points[k], points[k + 1]) >= degrees for k in range(len(points))]


def straighten(points: list[Point], held: list[bool], degrees: float = STRAIGHT) -> tuple[list[Point], list[bool]]:
    """Without inner points that aren't held and hardly turn against the point kept before."""
    kept = [(points[0], True)]
    for k in range(1, len(points) - 1):
        if held[k] or turn(kept[-1][0], points[k], points[k + 1]) >= degrees:
            kept.append((points[k], held[k]))
    kept.append((points[-1], True))
    return [p for p, _ in kept], [h for _, h in kept]


def farthest(points: list[Point], held: list[bool], reach: float = NEAR) -> list[bool]:
    """Points that stay: held ones and, between neighbours that stay, the farthest from their chord while beyond `reach`."""
    keep = list(held)
    anchors = [k for k, h in enumerate(held) if h]
    todo = list(zip(anchors, anchors[1:]))
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 or reach <= 0:
            continue
        away = [segment_distance(points[k], points[lo], points[hi]) for k in range(lo + 1, hi)]
        k = lo + 1 + max(range(len(away)), key=away.__getitem__)
        if away[k - lo - 1] > reach:
            keep[k] = True
            todo += [(lo, k), (k, hi)]
    return keep


def fewer(points: list[Point], reach: float = NEAR, area: float = AREA) -> list[Point]:
    """All three steps; small triangles go between held points only."""
    if len(points) < 3:
        return points
    points, held = straighten(points, corners(points))
    keep = farthest(points, held, reach) if reach > 0 else [True] * len(points)
    points, held = [p for p, k in zip(points, keep) if k], [h for h, k in zip(held, keep) if k]
    anchors = [k for k, h in enumerate(held) if h]
    out = [points[0]]
    for lo, hi in zip(anchors, anchors[1:]):
        out += simplify(points[lo : hi + 1], area)[1:] if area > 0 else points[lo + 1 : hi + 1]
    return out


def on_grid(p: Point, step: float) -> Point:
    return (round(p[0] / step) * step, round(p[1] / step) * step) if step > 0 else p


def simplify_path(data: str, reach: float = NEAR, area: float = AREA, grid: float = GRID) -> str:
    """Path data whose straight subpaths have fewer points; subpaths with curves stay."""
    paths = parse_path(data)
    for p in paths:
        if all(len(s) == 1 for s in p["segments"]):
            kept = fewer([p["start"], *[s[0] for s in p["segments"]]], reach, area)
            p["start"], p["segments"] = kept[0], [[q] for q in kept[1:]]
        p["start"], p["segments"] = on_grid(p["start"], grid), [[on_grid(q, grid) for q in s] for s in p["segments"]]
    return write_path(paths)
