"""Plane and path kernels, and the streaming form of the triage log."""

import math

import numpy as np
import pytest

from latticework.functions import svg
from latticework.operators import raster as R


def plane(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def test_morphology():
    dot = plane(".....", ".....", "..#..", ".....", ".....")
    assert R.dilate(dot).sum() == 9 and (R.erode(R.dilate(dot)) == dot).all() and not R.median3(dot).any()
    assert (R.closed(dot, 1) == dot).all() and not R.opened(dot).any()


def test_chamfer_and_hausdorff():
    ink = np.ones((5, 5), dtype=bool)
    ink[2, 2] = False
    d = R.chamfer(ink)
    assert d[2, 1] == 1.0 and d[1, 1] == 1.414 and d[0, 0] == 2.828 and d[0, 1] == 2.414
    assert R.inscribed_radius(np.ones((4, 6), dtype=bool)) == 2 and R.inscribed_radius(np.zeros((3, 3), dtype=bool)) == 0
    a, b = np.zeros((64, 64), dtype=bool), np.zeros((64, 64), dtype=bool)
    a[20:40, 20:40] = b[20:40, 22:42] = True
    assert abs(R.hausdorff(a, b) - 2 / math.sqrt(8192)) < 0.01 and R.hausdorff(a, np.zeros_like(a)) is None


def test_components_and_holes():
    ink = plane("##..#", "##.#.", ".....", "###..", "#.#..", "###..")
    lab = R.label(ink)
    assert lab.max() == 3 and lab[0, 4] == lab[1, 3] and R.holes(ink) == 1
    r = np.random.default_rng(0)
    ink = r.random((40, 40)) < 0.45
    lab, seen, n = R.label(ink), np.zeros((40, 40), dtype=int), 0
    for y in range(40):
        for x in range(40):
            if ink[y, x] and not seen[y, x]:
                n += 1
                todo = [(y, x)]
                seen[y, x] = n
                while todo:
                    v, u = todo.pop()
                    for q in range(max(0, v - 1), min(40, v + 2)):
                        for p in range(max(0, u - 1), min(40, u + 2)):
                            if ink[q, p] and not seen[q, p]:
                                seen[q, p] = n
                                todo.append((q, p))
    assert (lab == seen).all()


def test_shape_measures():
    square = np.zeros((20, 20), dtype=bool)
    square[5:15, 5:15] = True
    assert R.hull_area(square) == 81 + 18 + 1 and R.solidity(square) == 1.0
    m = R.metrics(square)
    assert (m["x"], m["y"], m["w"], m["h"], m["area"], m["cx"]) == (5, 5, 10, 10, 100, 9.5)
    seeds = R.strongest_apart(R.chamfer(square, padded=True), 3, 4)
    assert len(seeds) <= 4 and set(np.unique(R.watershed(square, seeds)[square])) == set(range(1, len(seeds) + 1))


def test_colour_and_clusters():
    lab = R.srgb_to_lab(np.array([[255, 255, 255], [0, 0, 0]]))
    assert abs(lab[0, 0] - 100) < 0.01 and abs(R.delta_e76(lab[0], lab[1]) - 100) < 0.05
    centres, side = R.kmeans_two(np.array([1, 2, 3, 100, 101]))
    assert centres.ravel().tolist() == [2, 100] and side.tolist() == [0, 0, 0, 1, 1]
    image = np.full((6, 6, 4), 200)
    image[2:4, 2:4] = 0
    assert R.border_consensus(image) == ((200, 200, 200), 1.0)
    assert R.block_ssim(np.arange(100).reshape(10, 10), np.arange(100).reshape(10, 10)) == 1.0
    assert R.normalise_plane(np.full((10, 5), 255)).shape == (64, 64)


def test_paths():
    assert svg.write_path(svg.parse_path("m1 2 3,4h5v-6.12345z")) == "M1 2 L4 6 L9 6 L9 -0.123 Z"
    assert svg.write_path(svg.parse_path("M0 0Q3 3 6 0T12 0")) == "M0 0 C2 2 4 2 6 0 C8 -2 10 -2 12 0"
    assert svg.write_path(svg.parse_path("M0 0C0 1 1 2 2 2S4 3 5 5")).count("C") == 2
    circle = svg.parse_path("M10 0A10 10 0 0 1 -10 0A10 10 0 0 1 10 0Z")
    assert all(abs(math.hypot(*p) - 10) < 0.01 for p in svg.flatten(circle)[0])
    polygon = svg.flatten(circle)
    assert svg.contains(polygon, 0, 0) and not svg.contains(polygon, 11, 0)
    assert abs(svg.outline_distance(polygon, (0, 0)) - 10) < 0.05
    for bad in ("L1 2", "M1", "M1 2 x", "5 5"):
        with pytest.raises(ValueError):
            svg.parse_path(bad)


def test_transforms():
    m = svg.parse_transform("translate(10, 5) rotate(90) scale(2)")
    assert tuple(round(v, 9) for v in svg.apply(m, (1, 0))) == (10, 7)
    assert all(abs(a - b) < 1e-9 for a, b in zip(svg.apply(svg.invert(m), svg.apply(m, (3, 4))), (3, 4)))
    assert svg.invert((0, 0, 0, 0, 1, 1)) is None
    assert svg.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.4) == [(0, 0), (2, 0), (2, 2)]


def test_planes_in_spark(spark):
    df = spark.createDataFrame([(1, [0, 1, 0, 1, 1, 1, 0, 1, 0]), (2, [0] * 9)], "id int, p array<int>")
    got = R.per_plane(df, ["id"], "p", 3, lambda p: {"area": int(p.sum()), "parts": int(R.label(p > 0).max())}, "area int, parts int").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 5, 1), (2, 0, 0)]


def test_stream_matches_batch(spark, sf, tmp_path):
    from latticework.plans.catalogue import decisions, triage_events
    from latticework.streaming import triage as stream

    events = triage_events(spark, sf).where("user_id < 6")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream.decisions(source).writeStream.format("memory").queryName("stood").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select * from stood").collect())
    assert got == sorted((r.user_id, r.icon, r.action, r.seq) for r in decisions(spark, sf).where("user_id < 6").collect())
