"""The grouping chain, splitting, segmentation, palettes, simplified paths and editing against plain versions and fixed vectors."""

import random

import numpy as np
import pytest

from latticework.functions import simplify as Q
from latticework.operators import boxes as B
from latticework.operators import editor as E
from latticework.operators import grouping as G
from latticework.operators import palette as A
from latticework.operators import segment as M
from latticework.operators import split as K


def median(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def merges(p, q, g, mh, ma):
    d = max(p["x"] - q["x"] - q["w"], q["x"] - p["x"] - p["w"], p["y"] - q["y"] - q["h"], q["y"] - p["y"] - p["h"], 0)
    ix, iy = (min(p[a] + p[s], q[a] + q[s]) - max(p[a], q[a]) for a, s in (("x", "w"), ("y", "h")))
    inter, aa, ba = max(0, ix) * max(0, iy), p["w"] * p["h"], q["w"] * q["h"]
    uw, uh = (max(p[a] + p[s], q[a] + q[s]) - min(p[a], q[a]) for a, s in (("x", "w"), ("y", "h")))
    if any(m["x"] <= n["x"] and m["y"] <= n["y"] and m["x"] + m["w"] >= n["x"] + n["w"] and m["y"] + m["h"] >= n["y"] + n["h"] for m, n in ((p, q), (q, p))) or inter / (aa + ba - inter) > 0.25:
        return True
    if d > g or max(uw, uh) > 4 * min(uw, uh) or uh > 1.9 * mh:
        return False
    first, last = (p, q) if p["id"] < q["id"] else (q, p)
    return min(aa, ba) <= 0.5 * max(aa, ba) or (d <= 0.5 * g and 0.6 <= first["h"] / last["h"] <= 1.6 and uw * uh <= 1.75 * ma)


def plain_merge(own, passes=3):
    mh, ma = median(b["h"] for b in own), median(b["w"] * b["h"] for b in own)
    g, now = max(4, min(40, 0.35 * mh)), [dict(b, of=[b["id"]]) for b in own]
    for _ in range(passes):
        root = {b["id"]: b["id"] for b in now}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        hits = [(p["id"], q["id"]) for i, p in enumerate(now) for q in now[i + 1 :] if merges(p, q, g, mh, ma)]
        if not hits:
            break
        for a, b in hits:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        groups = {}
        for b in now:
            groups.setdefault(find(b["id"]), []).append(b)
        now = []
        for k, m in groups.items():
            x, y = min(b["x"] for b in m), min(b["y"] for b in m)
            now.append({"id": k, "x": x, "y": y, "w": max(b["x"] + b["w"] for b in m) - x, "h": max(b["y"] + b["h"] for b in m) - y, "of": sorted(sum((b["of"] for b in m), []))})
    return now


def test_merge_passes(spark):
    r = random.Random(3)
    rows = [(s, s * 1000 + i, r.randrange(500), r.randrange(500), r.randrange(4, 30), r.randrange(4, 30)) for s in range(3) for i in range(70)]
    b = spark.createDataFrame(rows, "sheet int, id int, x int, y int, w int, h int")
    groups, roots, _ = G.merged(b, "sheet", "id")
    want, of = set(), set()
    for s in range(3):
        for g in plain_merge([dict(zip(("sheet", "id", "x", "y", "w", "h"), q)) for q in rows if q[0] == s]):
            want.add((s, g["id"], g["x"], g["y"], g["w"], g["h"], len(g["of"])))
            of |= {(o, g["id"]) for o in g["of"]}
    assert {(g.sheet, g.id, g.x, g.y, g.w, g.h, g.members) for g in groups.collect()} == want
    assert {tuple(x) for x in roots.collect()} == of
    one = B.MergeParams(passes=1)
    assert G.merged(b, "sheet", "id", one)[0].count() == sum(len(plain_merge([dict(zip(("sheet", "id", "x", "y", "w", "h"), q)) for q in rows if q[0] == s], 1)) for s in range(3))


def test_grid_takes_merges_apart(spark):
    """A lattice of 40-pixel icons; two neighbours that touch across a valley come back as they were."""
    rows = [(1, r * 5 + c, 10 + 64 * c, 10 + 64 * r, 40, 40) for r in range(5) for c in range(5)]
    rows += [(1, 100, 50, 20, 20, 10), (1, 101, 68, 20, 8, 8)]  # a bridge, in two pieces
    got = {g.id: g for g in G.group_all(spark.createDataFrame(rows, "sheet int, id int, x int, y int, w int, h int"), "sheet", "id", 400, 400).collect()}
    assert all(got[k].members == 1 and got[k].axes == 0 for k in range(2, 25))
    assert sum(g.restored for g in got.values()) >= 2 and got[0].restored and (got[0].w, got[0].h) == (40, 40)
    assert G.summary(G.group_all(spark.createDataFrame(rows, "sheet int, id int, x int, y int, w int, h int"), "sheet", "id", 400, 400), "sheet", "id", 400, 400).first().n == len(got)


def test_sensitivity():
    assert G.Sensitivity(merge_gap_frac=0.5).params().gap_factor == 0.5
    for bad in ({"merge_gap_frac": 2.0}, {"noise_min_area": 513}, {"grid_regularity_min": float("nan")}):
        with pytest.raises(ValueError):
            G.Sensitivity(**bad).params()
    c = G.Sensitivity(merge_gap_frac=float("nan"), merge_area_ratio=99, noise_min_area=-4).clamped()
    assert (c.merge_gap_frac, c.merge_area_ratio, c.noise_min_area) == (0.05, 8.0, 0)


def discs(*centres, shape=(24, 48), radius=8):
    y, x = np.mgrid[: shape[0], : shape[1]]
    return np.any([(x - a) ** 2 + (y - b) ** 2 <= radius * radius for a, b in centres], axis=0)


def test_split():
    two = discs((10, 12), (25, 12))
    labels = K.split(two[4:21, 2:34], 18)
    assert labels is not None and set(np.unique(labels)) == {0, 1, 2} and ((labels > 0) == two[4:21, 2:34]).all()
    left, right = K.regions(labels, 2, 4)
    assert left["x"] == 2 and right["x"] + right["w"] == 34 and abs(left["area"] - right["area"]) < 25
    assert K.split(discs((10, 12))[4:21, 2:19], 18) is None and K.split(np.ones((30, 30), dtype=bool), 10) is None
    bar = np.ones((6, 30), dtype=bool)
    bar[1:, 14] = False
    cut = K.bands(bar, 2)
    assert cut[0, 13] == 1 and cut[0, 14] == 2 and cut[1, 14] == 0
    # a sliver joins the neighbour that it touches most
    labels = np.zeros((10, 21), dtype=int)
    labels[:, :10], labels[:, 11:], labels[4:6, 10] = 1, 2, 3
    labels[4, 9] = 0
    assert set(np.unique(K.reattach(labels))) == {0, 1, 2} and K.reattach(labels)[5, 10] == 2
    mask = np.zeros((24, 60), dtype=bool)
    mask[:, :48], mask[0, 59] = two, True
    assert K.component(mask, (0, 0, 60, 24), (10, 12)).sum() == two.sum()


def test_segment():
    sheet = np.full((20, 20, 4), 255, dtype=np.uint8)
    sheet[5:15, 5:15, :3] = 10
    mask, bg = M.segment(sheet)
    assert bg.kind == "border" and bg.rgba == (255, 255, 255, 255) and mask[6:14, 6:14].all() and not mask[0].any()
    clear = sheet.copy()
    clear[:5, :, 3] = 0
    assert M.detect(clear).kind == "alpha" and M.ink(clear, M.detect(clear))[10, 10] and not M.ink(clear, M.detect(clear))[0, 0]
    half = np.zeros((20, 20, 4), dtype=np.uint8)
    half[..., 3] = 255
    half[:, :11, 0], half[:, 11:, 2] = 200, 200
    bg = M.detect(half)
    assert bg.kind == "kmeans" and bg.rgba == (200, 0, 0, 255) and M.ink(half, bg)[:, 11:].all() and not M.ink(half, bg)[:, :11].any()
    line = np.zeros((1, 9, 4), dtype=np.uint8)
    line[..., 3] = 255
    line[0, :6, :3] = 220
    assert M.detect(line).kind == "otsu" and M.ink(line, M.detect(line))[0].tolist() == [False] * 6 + [True] * 3


def test_palette():
    r = np.random.default_rng(1)
    samples = np.concatenate([c + r.integers(-4, 5, (80, 3)) for c in ([20, 20, 20], [200, 30, 40], [30, 220, 60])]).astype(np.int64)
    centres, own = A.kmeans(samples, 3)
    want = np.argmin(((samples[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
    assert (own == want).all() and all((centres[k] == samples[own == k].sum(axis=0) // (own == k).sum()).all() for k in range(3))
    assert len({tuple(own[80 * k : 80 * k + 80]) for k in range(3)}) == 3 and A.inertia(samples, centres, own) < 240 * 100
    assert [A.knee(c) for c in ([], [5.0], [9.0, 1.0], [100.0, 10.0, 9.0, 8.0], [4.0, 4.0, 4.0])] == [0, 1, 2, 2, 2]
    crop = np.zeros((16, 16, 4), dtype=np.uint8)
    crop[:, :10], crop[:, 10:15], crop[3, 15] = (250, 0, 0, 255), (0, 0, 250, 255), (0, 250, 0, 255)
    found = A.layers(crop)
    assert [x["area"] for x in found][:2] == [160, 80] and found[0]["rgba"] == (250, 0, 0, 255)
    assert (A.composed(found, (16, 16))[:, :10] == (250, 0, 0, 255)).all() and A.layers(np.zeros((4, 4, 4), dtype=np.uint8)) == []


def test_simplify():
    assert Q.turn((0, 0), (1, 0), (2, 0)) == 0 and abs(Q.turn((0, 0), (1, 0), (1, 1)) - 90) < 1e-9
    square = [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    assert Q.fewer(square) == [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    wave = [(float(k), 0.1 * (k % 2)) for k in range(20)]
    assert Q.fewer(wave) == [wave[0], wave[-1]] and Q.fewer(wave, 0, 0) != [wave[0], wave[-1]]
    bump = [(0.0, 0.0), (5.0, 2.0), (10.0, 0.0)]
    assert Q.farthest(bump, [True, False, True], 1.0) == [True] * 3 and Q.farthest(bump, [True, False, True], 3.0) == [True, False, True]
    assert Q.simplify_path("M0 0L5 0L10 0L10 10", grid=0) == Q.write_path(Q.parse_path("M0 0L10 0L10 10"))
    assert Q.simplify_path("M0 0C1 1 2 1 3 0", grid=0) == Q.write_path(Q.parse_path("M0 0C1 1 2 1 3 0"))


def test_history(spark):
    r = random.Random(2)
    rows = [(s, k, r.choice(["push", "push", "undo", "redo"])) for s in range(3) for k in range(60)]
    got = {(x.s, x.k): (x.depth, x.stands) for x in E.history(spark.createDataFrame(rows, "s long, k long, step string"), "s", ["k"], "step", 5).collect()}
    for s in range(3):
        done, undone = [], []
        for _, k, step in (q for q in rows if q[0] == s):
            if step == "push":
                done, undone = [*done, k][-5:], []
            elif step == "undo" and done:
                undone.append(done.pop())
            elif step == "redo" and undone:
                done.append(undone.pop())
            assert got[s, k][0] == len(done)
        assert {k for (q, k), v in got.items() if q == s and v[1]} == set(done)
