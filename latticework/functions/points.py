"""Edits of single points of parsed paths: each returns new subpaths and leaves its argument alone."""

from __future__ import annotations

from copy import deepcopy

from .svg import Point


def _points(path: dict) -> list[Point]:
    return [path["start"], *[s[-1] for s in path["segments"]]]


def _moved(p: Point, d: Point) -> Point:
    return (p[0] + d[0], p[1] + d[1])


def move_point(paths: list[dict], path: int, point: int, to: Point) -> list[dict]:
    """A vertex at another place; the handles beside it come along."""
    out = deepcopy(paths)
    p = out[path]
    old = _points(p)[point]
    d = (to[0] - old[0], to[1] - old[1])
    if point == 0:
        p["start"] = to
    else:
        s = p["segments"][point - 1]
        p["segments"][point - 1] = (to,) if len(s) == 1 else (s[0], _moved(s[1], d), to)
    if point < len(p["segments"]) and len(p["segments"][point]) == 3:
        s = p["segments"][point]
        p["segments"][point] = (_moved(s[0], d), s[1], s[2])
    return out


def move_handle(paths: list[dict], path: int, segment: int, handle: int, to: Point) -> list[dict]:
    """The first (0) or second (1) handle of a cubic elsewhere."""
    out = deepcopy(paths)
    s = list(out[path]["segments"][segment])
    if len(s) != 3 or handle not in (0, 1):
        raise ValueError("a line has no handles")
    s[handle] = to
    out[path]["segments"][segment] = tuple(s)
    return out


def insert_point(paths: list[dict], path: int, segment: int, t: float) -> list[dict]:
    """A vertex at t along a segment, whose shape stays."""
    if not 0 < t < 1:
        raise ValueError("a new point lies inside its segment")
    out = deepcopy(paths)
    p = out[path]
    mix = lambda a, b: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    a, s = _points(p)[segment], p["segments"][segment]
    if len(s) == 1:
        p["segments"][segment : segment + 1] = [(mix(a, s[0]),), s]
    else:
        ab, bc, cd = mix(a, s[0]), mix(s[0], s[1]), mix(s[1], s[2])
        abc, bcd = mix(ab, bc), mix(bc, cd)
        p["segments"][segment : segment + 1] = [(ab, abc, mix(abc, bcd)), (bcd, cd, s[2])]
    return out


def delete_point(paths: list[dict], path: int, point: int) -> list[dict]:
    """Without a vertex: its neighbours are joined, by a cubic with their outer handles if either side was one."""
    out = deepcopy(paths)
    p = out[path]
    segments = p["segments"]
    if len(segments) < 2:
        raise ValueError("a path keeps two points")
    if point == 0:
        p["start"] = segments.pop(0)[-1]
    elif point == len(segments):
        segments.pop()
    else:
        before, after, a = segments[point - 1], segments[point], _points(p)[point - 1]
        curved = len(before) == 3 or len(after) == 3
        segments[point - 1 : point + 1] = [(before[0] if len(before) == 3 else a, after[1] if len(after) == 3 else after[-1], after[-1]) if curved else after]
    return out


def set_segment(paths: list[dict], path: int, segment: int, cubic: bool) -> list[dict]:
    """A segment as a line, or as a cubic with its handles at the thirds."""
    out = deepcopy(paths)
    p = out[path]
    a, s = _points(p)[segment], p["segments"][segment]
    if cubic == (len(s) == 3):
        raise ValueError("the segment is one already")
    b = s[-1]
    third = lambda k: (a[0] + (b[0] - a[0]) * k / 3, a[1] + (b[1] - a[1]) * k / 3)
    p["segments"][segment] = (third(1), third(2), b) if cubic else (b,)
    return out
