"""Boxes of one tile of a sheet joined into components by the merge rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Candidate pairs that are looked at at once.
MANY = 1 << 20


def settle(roots: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """roots (each node's smallest, settled) after the links u, v."""
    while True:
        a, b = roots[u], roots[v]
        apart = a != b
        if not apart.any():
            return roots
        u, v = a[apart], b[apart]
        np.minimum.at(roots, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(roots, after := roots[roots]):
            roots = after


def candidates(x, y, w, h, reach) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at most `reach` apart, each once: in bands twice as high as a box, by a sweep from left to right."""
    n = len(x)
    high = max(float(2 * np.maximum(h, 0).mean() + reach), 1.0)
    first = np.floor(y / high).astype(np.int64)
    last = np.maximum(first, np.floor((y + h + reach) / high).astype(np.int64))
    times = last - first + 1
    who = np.repeat(np.arange(n), times)
    band = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + first[who]
    # places along x by rank, so that (band, place) is one whole number
    sorted_x = np.sort(x)
    begin, end = np.searchsorted(sorted_x, x, "left"), np.searchsorted(sorted_x, x + np.maximum(w, 0) + reach, "right")
    key = (band - first.min()) * (n + 1) + begin[who]
    order = np.argsort(key, kind="stable")
    who, band, key = who[order], band[order], key[order]
    at = np.arange(len(who))
    until = np.searchsorted(key, key - begin[who] + end[who], "left")
    count = np.maximum(until - at - 1, 0)
    total = np.cumsum(count)
    lo = 0
    while lo < len(who):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MANY, "right")), lo + 1)
        here = count[lo:hi]
        i = np.repeat(at[lo:hi], here)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here)
        p, q = who[i], who[j]
        near = (y[q] - y[p] - h[p] <= reach) & (y[p] - y[q] - h[q] <= reach) & (x[p] - x[q] - w[q] <= reach) & (x[q] - x[p] - w[p] <= reach)
        near &= np.maximum(first[p], first[q]) == band[i]
        yield p[near], q[near]
        lo = hi


def merges(x, y, w, h, least, most, p, q, mh: float, ma: float, g: float, rules) -> np.ndarray:
    """Which of the pairs p, q merge by R4, R1 or R5; least and most: the ids of the boxes that are such a one."""
    (px, py, pw, ph), (qx, qy, qw, qh) = ([c[k] for c in (x, y, w, h)] for k in (p, q))
    uw = np.maximum(px + pw, qx + qw) - np.minimum(px, qx)
    uh = np.maximum(py + ph, qy + qh) - np.minimum(py, qy)
    ix = np.minimum(px + pw, qx + qw) - np.maximum(px, qx)
    iy = np.minimum(py + ph, qy + qh) - np.maximum(py, qy)
    inter = np.maximum(ix, 0) * np.maximum(iy, 0)
    pa, qa = pw * ph, qw * qh
    union = (pa + qa - inter).astype(float)
    holds = ((px <= qx) & (py <= qy) & (px + pw >= qx + qw) & (py + ph >= qy + qh)) | ((qx <= px) & (qy <= py) & (qx + qw >= px + pw) & (qy + qh >= py + ph))
    r4 = holds | (np.divide(inter, union, out=np.zeros(len(union)), where=union != 0) > rules.overlap_iou)
    d = np.maximum(np.maximum(-ix, -iy), 0)
    fits = (d <= g) & (np.maximum(uw, uh) <= rules.merged_aspect * np.minimum(uw, uh)) & (uh <= rules.merged_height * mh)
    r1 = np.minimum(pa, qa) <= rules.small_ratio * np.maximum(pa, qa)
    # the ratio is that of the box with the smaller id to the other
    band = lambda a, b: (lambda ratio: (ratio >= rules.band_lo) & (ratio <= rules.band_hi))(np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0))
    like = ((least[p] < most[q]) & band(ph, qh)) | ((least[q] < most[p]) & band(qh, ph))
    r5 = (d <= rules.near_gap * g) & like & (uw * uh <= rules.band_area * ma)
    return r4 | (fits & (r1 | r5))


def components(x, y, w, h, ids, mh: float, ma: float, g: float, rules) -> np.ndarray:
    """For each box the place of a box that stands for its component. Copies always merge, and are compared as one."""
    x, y, w, h = (c.astype(float if c.dtype.kind == "f" else np.int64) for c in (x, y, w, h))
    order = np.lexsort((ids, h, w, y, x))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in (x, y, w, h)], axis=0)
    starts = np.flatnonzero(fresh)
    one = order[starts]  # ids ascend within copies
    least, most = ids[one], ids[order[np.append(starts[1:], len(order)) - 1]]
    own = tuple(c[one] for c in (x, y, w, h))
    roots = np.arange(len(one))
    for p, q in candidates(*own, int(np.ceil(g))):
        hit = merges(*own, least, most, p, q, mh, ma, g, rules)
        roots = settle(roots, p[hit], q[hit])
    out = np.empty(len(order), np.int64)
    out[order] = one[roots][np.cumsum(fresh) - 1]
    return out
