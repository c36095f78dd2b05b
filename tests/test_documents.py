"""SVG and PDF documents, polygon booleans and point edits."""

import random

import pytest

from latticework.functions import points as V
from latticework.functions import polygons as P
from latticework.functions.svg import contains, flatten, outline_distance, parse_path, write_path
from latticework.sources import documents as D
from latticework.sources import pdf

ICON = '<?xml version="1.0"?><!-- c --><svg viewBox="0 0 20 10"><title>a &amp; b</title><g transform="translate(2 1)" fill="#f00"><path d="M0 0L4 0L4 4Z"/><g transform="scale(2)"><path d="M1 1L2 1" fill="#00ff0080"/></g></g></svg>'


def test_svg_reader():
    doc = D.parse(ICON)
    assert doc.view == (0, 0, 20, 10) and [s.fill for s in doc.shapes] == ["#ff0000ff", "#00ff0080"]
    assert doc.shapes[0].paths[0]["start"] == (2, 1) and doc.shapes[1].paths[0]["segments"] == [((6, 3),)]
    assert D.outline(doc.shapes) == (3, False) and D.palette(doc.shapes)[1] == 2 and D.palette(doc.shapes[::-1]) == D.palette(doc.shapes)
    for bad in ("", "<g></g>", "<svg viewBox='0 0 1 1'>", "<svg viewBox='0 0 1 1'><a></svg>", "<svg viewBox='0 0 0 1'/>", "<svg viewBox='0 0 1 1'><circle/></svg>", "<svg viewBox='0 0 1 1'/><svg/>", "<svg viewBox='0 0 1 1'><path d='L1 1'/></svg>", "<svg a='1' a='2' viewBox='0 0 1 1'/>", "<svg viewBox='0 0 1 1'><path fill='red' d=''/></svg>"):
        with pytest.raises(ValueError):
            D.parse(bad)


def test_svg_writers():
    shapes = [("#ff0000ff", "M0 0L4 0L4 4Z"), ("#ff0000ff", "M5 5L6 5L6 6Z"), ("#0000ff80", "M1 1L2 1L2 2Z")]
    text = D.write_icon(8, 8, shapes)
    back = D.parse(text)
    assert [s.fill for s in back.shapes] == ["#ff0000ff", "#0000ff80"] and len(back.shapes[0].paths) == 2
    sheet = D.write_sheet(100, 50, [{"id": 1, "tx": 10, "ty": 20, "scale": 2, "shapes": shapes}], "a < b")
    assert D.check(sheet) == (100, 50) and D.parse(sheet).shapes[0].paths[0]["segments"][0] == ((18, 20),)
    with pytest.raises(ValueError):
        D.write_sheet(100, 50, [{"id": 2, "tx": 0, "ty": 0, "scale": 1, "shapes": None}])
    assert D.rewrite_paths(text, lambda d: "M9 9") .count('d="M9 9"') == 2


def test_documents_of_a_table(spark):
    rows = [(1, ICON), (2, None), (3, "<svg"), (4, "<svg viewBox='0 0 3 4'></svg>")]
    got = {r.k: r for r in D.read_documents(spark.createDataFrame(rows, "k long, doc string"), "doc").collect()}
    assert (got[1].width, got[1].fills, got[1].nodes, got[1].closed, len(got[1].shapes)) == (20, 2, 3, False, 2) and got[1].error is None
    assert got[2].error and got[3].error and got[4].shapes == [] and got[4].closed


def test_pdf():
    blob = pdf.write(100, 40, [{"tx": 1, "ty": 2, "scale": 0.5, "shapes": [("#ff0000", "M0 0L4 0L4 4Z"), ("#00ff00", "M0 0C1 1 2 2 3 0Z")]}], "t (é)\\")
    assert pdf.read(blob) == {"pages": 1, "width": 75.0, "height": 30.0, "fills": 2}
    for bad in (b"", blob[5:], blob[:-20], blob.replace(b"/Length ", b"/Length 1"), blob.replace(b"4 0 obj", b"9 0 obj"), blob.replace(b"/Count 1", b"/Count 2"), blob.replace(b"/MediaBox [0 0 75", b"/MediaBox [0 0 -5")):
        with pytest.raises(ValueError):
            pdf.read(bad)


@pytest.mark.parametrize("seed", range(6))
def test_booleans_point_by_point(seed):
    """Inside of the result against the rule on the insides of both, at points away from all edges."""
    r = random.Random(seed)
    shape = lambda n: [[(r.randrange(40) / 2, r.randrange(40) / 2) for _ in range(n)] for _ in range(2)]
    a, b = (shape(5), shape(4)) if seed else ([[(0, 0), (10, 0), (10, 10), (0, 10)]], [[(5, 0), (15, 0), (15, 10), (5, 10)]])
    for op, rule in P._OPS.items():
        got = P.combine(a, b, op)
        for _ in range(400):
            x, y = r.random() * 20 + 1e-4, r.random() * 20 + 1e-4
            if min(abs(x * 2 - round(x * 2)), abs(y * 2 - round(y * 2))) > 0.02 and all(abs((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])) > 0.2 for s in (a, b) for w in s for p, q in zip(w, w[1:] + w[:1])):
                assert contains(got, x, y) == rule(contains(a, x, y), contains(b, x, y))
    if not seed:
        assert [abs(P.area(P.combine(a, b, op))) for op in ("union", "subtract", "intersect", "exclude")] == [150, 50, 50, 100]
        assert P.fold([a, b, b], "subtract") == P.combine(a, b, "subtract") and P.fold([], "union") == [] and P.fold([[], a], "intersect") == []


def test_points():
    line = parse_path("M0 0L10 0L10 10")
    assert write_path(V.move_point(line, 0, 1, (8, 1))) == "M0 0 L8 1 L10 10" and write_path(line) == "M0 0 L10 0 L10 10"
    assert write_path(V.insert_point(line, 0, 1, 0.5)) == "M0 0 L10 0 L10 5 L10 10" and write_path(V.delete_point(line, 0, 1)) == "M0 0 L10 10"
    curve = parse_path("M0 0C0 10 10 10 10 0")
    cut = V.insert_point(curve, 0, 0, 0.25)
    assert all(outline_distance(flatten(curve), q) < 0.05 for q in flatten(cut)[0]) and len(cut[0]["segments"]) == 2
    assert V.set_segment(curve, 0, 0, False)[0]["segments"] == [((10.0, 0.0),)] and V.move_handle(curve, 0, 0, 1, (3, 3))[0]["segments"][0][1] == (3, 3)
    assert V.set_segment(line, 0, 0, True)[0]["segments"][0][0] == (10 / 3, 0)
    for bad in (lambda: V.insert_point(line, 0, 0, 1.0), lambda: V.move_handle(line, 0, 0, 0, (1, 1)), lambda: V.set_segment(line, 0, 0, False), lambda: V.delete_point(parse_path("M0 0L1 1"), 0, 0)):
        with pytest.raises(ValueError):
            bad()


def test_area_columns_go_many_at_a_time(spark):
    """Areas of batches are those of the operations one by one: holes, gaps, copies, slanted edges, nothing."""
    r = random.Random(6)

    def box():
        x, y, w, h = r.randrange(40), r.randrange(40), r.randrange(1, 30), r.randrange(1, 30)
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]

    def shape():
        twice = box()
        return r.choice([[], [box()], [box(), box()], [twice, twice], [[(0, 0), (20.5, 0), (20.5, 10), (10, 10), (10, 30), (0, 30)]], [[(r.randrange(30), r.randrange(30)) for _ in range(3)]]])

    rows = [(k, shape(), shape()) for k in range(200)] + [(200, None, [box()])]
    whole = lambda s: None if s is None else [[(float(x), float(y)) for x, y in p] for p in s]
    ring = "array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame([(k, whole(a), whole(b)) for k, a, b in rows], f"k int, p {ring}, q {ring}")
    ops = ("union", "subtract", "intersect", "exclude")
    got = P.area_columns(df, "p", "q", ops)
    assert got.columns == ["k", *(f"{op}_area" for op in ops)]
    for op in ops:
        one = {x.k: x[f"{op}_area"] for x in P.combine_columns(df, "p", "q", op, op).collect()}
        assert {x.k: x[f"{op}_area"] for x in got.collect()} == pytest.approx(one)
