"""Fixed vectors of the sheet operators."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.functions import scalars as S
from latticework.functions import texts as X
from latticework.operators import boxes as B
from latticework.operators import lattice as L
from latticework.operators import leveling as V
from latticework.operators import planes as P
from latticework.operators import robust as Z
from latticework.operators import triage as T
from latticework.operators.graph import connected_components
from latticework.sources import library as Y


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_median_and_modified_z(spark):
    rows = [(i, 10.0) for i in range(99)] + [(99, 40.0)]
    out = Z.outlier_scan(spark.createDataFrame(rows, "id int, v double").withColumn("g", F.lit(1)), ["g"], ["id"], ["v"]).collect()
    assert [r.id for r in out] == [99] and out[0].z > 3.5
    assert not Z.outlier_scan(spark.createDataFrame([(i, 5.0) for i in range(9)], "id int, v double").withColumn("g", F.lit(1)), ["g"], ["id"], ["v"]).collect()


def test_modal_palette(spark):
    four = spark.createDataFrame([(1, i, i) for i in range(4)], "g int, id int, p int")
    assert Z.modal_value(four, ["g"], "p").count() == 0
    rows = [(1, i, 7) for i in range(8)] + [(1, 8, 999)]
    out = Z.modal_mismatch(spark.createDataFrame(rows, "g int, id int, p int"), ["g"], ["id"], "p").collect()
    assert [(r.id, r.mode) for r in out] == [(8, 7)]


def test_downscale_and_hashes(spark):
    plane = F.array(*[F.lit(v) for v in (0, 100, 200, 255)])
    assert one(spark, P.downscale(plane, 4, 1, 2, 1).alias("d")).d == [50, 228]
    falling = F.array(*[F.lit(255 - x) for _ in range(8) for x in range(9)])
    assert one(spark, S.hex64(P.dhash(falling)).alias("h")).h == "f" * 16
    half = F.array(*[F.lit(255 if x >= 4 else 0) for _ in range(8) for x in range(8)])
    assert one(spark, S.hex64(P.ahash(half)).alias("h")).h == "f0" * 8
    assert one(spark, P.ahash(F.array(*[F.lit(9)] * 64)).alias("h")).h == 0


def test_band_keys(spark):
    h = F.lit(0x0123456789ABCDEF)
    assert [(k.band, k.key) for k in one(spark, P.band_keys(h, 4).alias("k")).k] == [(0, 0xCDEF), (1, 0x89AB), (2, 0x4567), (3, 0x0123)]
    assert one(spark, P.band_keys(h, 3).alias("k")).k == []


def test_lsh_candidates_and_clusters(spark):
    rows = spark.createDataFrame([(0, 5, 5), (1, 5, 5), (2, -1, -1)], "id int, a long, d long")
    assert [tuple(r) for r in P.lsh_candidates(rows, [], "id", ["a", "d"], 4).collect()] == [(0, 1)]
    scores = spark.createDataFrame([(7, 0.4), (9, 0.9), (4, 0.5)], "id int, s double")
    got = P.clusters(spark.createDataFrame([(7, 9)], "a int, b int"), scores, "id", "s").first()
    assert (got.members, got.keeper) == ([7, 9], 9)


def test_iou_ssim(spark):
    a, b = F.array(*[F.lit(200)] * 64), F.array(*[F.lit(0)] * 64)
    r = one(spark, P.ink_iou(a, a).alias("x"), P.ink_iou(a, b).alias("y"), P.ink_iou(b, b).alias("z"), P.ssim_block(a, a).alias("s"))
    assert (r.x, r.y, r.z) == (1, 0, 1) and abs(r.s - 1) < 1e-12


def test_quality_flags(spark):
    f = lambda *v: one(spark, S.quality_flags(*[F.lit(x) for x in v]).alias("f")).f
    assert f(0.799, 1, 1600, True) == ["low_composite"] and f(0.80, 160, 1600, True) == []
    assert f(0.9, 161, 1600, False) == ["too_many_nodes", "open_outline"] and f(0.9, 500, 0, True) == []


def test_names(spark):
    assert [one(spark, S.slugify(F.lit(v)).alias("s")).s for v in ("Arrow Up.svg", "--", "a/b\\c:d")] == ["arrow-up-svg", "icon", "a-b-c-d"]
    t = {"sheet": F.lit("shapes"), "index": F.lit(7)}
    assert [one(spark, S.expand_pattern(p, t).alias("s")).s for p in ("{sheet}-{index:03}", "{index:2}", "{nope}", "open{index")] == ["shapes-007", "07", "{nope}", "open{index"]
    assert [one(spark, S.derive_tags(F.lit("scan"), F.lit(n), F.lit(k), F.lit(s), F.lit(100)).alias("s")).s for n, k, s in ((100, 30, 1.0), (0, 5, 0.3), (9, 25, 0.7))] == ["solid thick ink scan", "hollow thin empty scan", "mixed even ink scan"]
    assert [one(spark, S.format_number(F.lit(v)).alias("s")).s for v in (1.5, 2.0, -0.0001, float("nan"), 0.1234)] == ["1.5", "2", "0", "0", "0.123"]
    assert [one(spark, S.csv_field(F.lit(v)).alias("s")).s for v in ("a", "a,b", 'a"b', " a")] == ["a", '"a,b"', '"a""b"', '" a"']
    assert one(spark, S.parse_hex_colour(F.lit("#abc")).alias("c")).c == [0xAA, 0xBB, 0xCC, 255]


def test_grid_position_and_fit(spark):
    p = lambda n, c: tuple(one(spark, V.grid_position(F.lit(n), c).alias("p")).p)
    assert [p(1, 3), p(4, 3), p(1, 0)] == [(1, 1), (2, 1), (1, 1)]
    assert V.fit_columns(float("nan"), V.SheetSpec()) == 1 and V.SheetSpec(ink_ratio=float("nan")).clamped().ink_ratio == 0.8


def test_leveling_fixture(spark):
    icons = spark.createDataFrame([("s", i, 20, 20, 2.0, 0.9) for i in range(8)], "sheet string, id int, ink_w int, ink_h int, stroke double, solidity double")
    r = V.level(V.grid_layout(icons, "sheet", ["id"], V.SheetSpec()), "sheet", V.SheetSpec()).orderBy("id").first()
    assert abs(r.scale - 1.92) < 1e-9 and abs(r.out_w - 38.4) < 1e-9 and abs(r.x - 20.8) < 1e-9 and r.flags == 0


def test_lattice_fixture(spark):
    rows = [(1, r * 4 + c, 8 + 64 * c, 8 + 64 * r, 40, 40) for r in range(4) for c in range(4)]
    b = spark.createDataFrame(rows, "sheet int, id int, x int, y int, w int, h int")
    x = L.valleys(L.profile(b, "sheet"), "sheet")
    y = L.valleys(L.profile(b, "sheet", "y", "h", "w"), "sheet")
    r = L.regularity(x, "sheet").first()
    assert (r.n_valleys, r.pitch, r.regularity) == (3, 64, 1.0)
    odd = spark.createDataFrame([(1, 0, 8, 8, 40, 40), (1, 1, 10, 8, 108, 40), (1, 2, 8, 10, 40, 108), (1, 3, 63, 8, 3, 40)], b.schema)
    assert [q.axes for q in L.classify(odd, x, y, "sheet").orderBy("id").collect()] == [0, 1, 2, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_pairs_match_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(s, s * 1000 + i, r.randrange(300), r.randrange(300), r.randrange(3, 40), r.randrange(3, 40)) for s in range(3) for i in range(60)]
    b = spark.createDataFrame(rows, "sheet int, id int, x int, y int, w int, h int")
    got = {(x.a, x.b): x.rule for x in B.merge_pairs(b, "sheet", "id").collect()}
    want = {}
    for s in range(3):
        own = [q for q in rows if q[0] == s]
        hs, areas = sorted(q[5] for q in own), sorted(q[4] * q[5] for q in own)
        mh, ma = (hs[29] + hs[30]) / 2, (areas[29] + areas[30]) / 2
        g = max(4, min(40, 0.35 * mh))
        for i, p in enumerate(own):
            for q in own[i + 1 :]:
                d = max(p[2] - q[2] - q[4], q[2] - p[2] - p[4], p[3] - q[3] - q[5], q[3] - p[3] - p[5], 0)
                ix, iy = min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]), min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])
                inter = max(0, ix) * max(0, iy)
                aa, ba = p[4] * p[5], q[4] * q[5]
                holds = any(m[2] <= n[2] and m[3] <= n[3] and m[2] + m[4] >= n[2] + n[4] and m[3] + m[5] >= n[3] + n[5] for m, n in ((p, q), (q, p)))
                uw, uh = max(p[2] + p[4], q[2] + q[4]) - min(p[2], q[2]), max(p[3] + p[5], q[3] + q[5]) - min(p[3], q[3])
                rule = None
                if holds or inter / (aa + ba - inter) > 0.25:
                    rule = "R4"
                elif d > g:
                    rule = None
                elif max(uw, uh) > 4 * min(uw, uh):
                    rule = "aspect"
                elif uh > 1.9 * mh:
                    rule = "height"
                elif min(aa, ba) <= 0.5 * max(aa, ba):
                    rule = "R1"
                elif d <= 0.5 * g and 0.6 <= p[5] / q[5] <= 1.6 and uw * uh <= 1.75 * ma:
                    rule = "R5"
                if rule:
                    want[p[1], q[1]] = rule
    assert got == want


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def stack(events):
    live, n = [], 0
    for e in events:
        if e[1] == "undo":
            if live:
                live.pop()
        else:
            live.append((e[1], e[2], n))
            n += 1
    out = {}
    for a, i, s in live:
        out[i] = (a, s)
    return out


def test_replay_is_a_stack(spark):
    r = random.Random(9)
    rows, want = [], {}
    for s in range(150):
        own = [(k, r.choice(["approve", "flag", "reject", "undo", "undo"]), r.randrange(3)) for k in range(r.randrange(1, 14))]
        want |= {(s, i): v for i, v in stack(own).items()}
        rows += [(s, *e) for e in own]
    df = spark.createDataFrame(rows, "s int, k int, action string, icon int").withColumn("at", F.col("k"))
    assert {(x.s, x.icon): (x.action, x.seq) for x in T.replay(df, "s", ["k"], "action", "icon", "at").collect()} == want


def test_triage_csv(spark):
    d = spark.createDataFrame([("s", 9, "reject", 0, 111), ("s", 2, "approve", 1, 222)], "s string, icon int, action string, seq long, at long")
    assert T.to_csv(d, "s", "icon").first().csv == "seq,id,action,at_ms\r\n0,9,reject,111\r\n1,2,approve,222\r\n"


def test_library(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, body string")
    got = {r.id: r.outcome for r in Y.dedupe_import(rows, "body", ["id"], Y.dedupe_import(rows.where("id = 3"), "body", ["id"])).collect()}
    assert got == {1: "imported", 2: "duplicate", 3: "duplicate"}
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\x08\x06\0\0\0"
    (tmp_path / "x.PNG").write_bytes(png)
    (tmp_path / "y.jpg").write_bytes(b"junk")
    (tmp_path / "z.txt").write_bytes(png)
    got = {r.path[-5:]: (r.status, r.width, r.height) for r in Y.scan_images(spark, str(tmp_path)).collect()}
    assert got == {"x.PNG": ("ok", 3, 5), "y.jpg": ("corrupt", None, None)}


def test_shared_part_components_of_all_parts(spark, tmp_path):
    from latticework.plans.catalogue import QUERIES

    r = random.Random(6)
    rows = sorted({(r.randrange(60), 16 * r.randrange(40) + r.randrange(1, 16)) for _ in range(70)})
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    root = {s: s for s, _ in rows}
    links = [(a, b) for a, p in rows for b, q in rows if p == q and a != b]
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {a: root[a] for a, _ in links}
    assert want and {x.node: x.component for x in QUERIES["shared_part_components"](spark, str(tmp_path)).collect()} == want


def test_box_pair_geometry_of_all_sheets(spark, tmp_path):
    from latticework.plans.catalogue import QUERIES, REACH, boxes

    r = random.Random(8)
    rows = [(r.choice([3, 8, 300, 511]), k, r.randrange(1, 900), r.randrange(1, 90), r.randrange(1, 51)) for k in range(500)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity int").write.parquet(str(tmp_path / "lineitem.parquet"))
    b = boxes(spark, str(tmp_path)).collect()
    want = {}
    for p in b:
        for q in b:
            if p.sheet == q.sheet and p.id < q.id:
                gap = max(p.x - q.x - q.w, q.x - p.x - p.w, p.y - q.y - q.h, q.y - p.y - p.h, 0)
                i = max(0, min(p.x + p.w, q.x + q.w) - max(p.x, q.x)) * max(0, min(p.y + p.h, q.y + q.h) - max(p.y, q.y))
                if gap <= REACH:
                    want[p.sheet, p.id, q.id] = (gap, round(i / (p.w * p.h + q.w * q.h - i), 6), i > 0)
    got = {(x.sheet, x.a, x.b): (x.gap, x.iou, x.meets) for x in QUERIES["box_pair_geometry"](spark, str(tmp_path)).collect()}
    assert {s for s, _, _ in want} == {3, 8, 300, 511} and any(m for *_, m in want.values()) and got == want


def test_csv_quote_of_whole_pages(spark, tmp_path):
    from latticework.plans.catalogue import QUERIES

    long = "a" * 5000
    rows = [(1, long), (2, long + ',"b'), (3, long + "\n"), (4, "x")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x.page_id: x.field for x in QUERIES["csv_quote"](spark, str(tmp_path)).collect()}
    assert got == {1: long, 2: f'"{long},""b"', 3: f'"{long}\n"', 4: "x"}


def test_pace_rounds_as_sql_does(spark):
    """Minutes a hair below a half of a tenth, as DuckDB's round has them."""
    import duckdb

    ids = [49, 12999, 51849, 114327, 115677]
    got = [r.p for r in spark.createDataFrame([(i,) for i in ids], "id long").select(X.pace_line(F.col("id") % 50, F.col("id"), F.col("id") * 1000).alias("p")).collect()]
    p = "id * 1000 / (id % 50)::double * id"
    sql = f"select printf('%.1f min projected, ', round({p} / 60000, 1)) || case when {p} <= 1200000 then 'within budget' else 'over budget' end from (select unnest({ids}::bigint[]) id)"
    assert got == [r[0] for r in duckdb.sql(sql).fetchall()]
    assert got[1] == "57474.2 min projected, over budget"


def largest_method(spark, df):
    """Bytes of the largest method that df's plan is compiled to; the JVM interprets those above 8,000."""
    import re

    shown = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown.codegenString(df._jdf.queryExecution().executedPlan()))))


@pytest.mark.parametrize("name", ["box_merge_pairs", "box_pair_geometry"])
def test_pair_joins_are_compiled(spark, sf, name):
    from latticework.plans.catalogue import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert 0 < largest_method(spark, QUERIES[name](spark, sf)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("reach", [0, 5])
def test_near_pairs_of_unlike_boxes(spark, reach):
    """Boxes of all sizes, left of and above the origin too, some of them copies: each pair once."""
    r = random.Random(reach)
    rows = [(i % 2, i, r.randrange(-300, 300), r.randrange(-300, 300), *(r.choice([0, 1, 9, 40, 500]) for _ in range(2))) for i in range(150)]
    rows += [(s, 1000 + i, *q) for i, (s, _, *q) in enumerate(rows[:20])]
    got = [(p.a_id, p.b_id) for p in B.near_pairs(spark.createDataFrame(rows, "sheet int, id int, x int, y int, w int, h int"), "sheet", "id", reach).collect()]
    near = lambda p, q: max(p[2] - q[2] - q[4], q[2] - p[2] - p[4], p[3] - q[3] - q[5], q[3] - p[3] - p[5]) <= reach
    assert sorted(got) == sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and near(p, q))


@pytest.mark.parametrize("tile", [3, 4096])
def test_merge_pass_by_tiles(spark, monkeypatch, tile):
    """Components that reach over many tiles, copies, chains, boxes with a null: as the listed pairs join them."""
    monkeypatch.setattr(B, "TILE", tile)
    r = random.Random(tile)
    rows = [[s, s * 1000 + i, r.randrange(-100, 250), r.randrange(-100, 250), r.randrange(0, 40), r.randrange(1, 40)] for s in range(3) for i in range(170)]
    rows += [[s, 5000 + 9 * i, *q] for i, (s, _, *q) in enumerate(rows[:60])] + [[1, 7000 + i, 600 + 9 * i, 600 + i % 2, 10, 10 + 4 * (i % 3)] for i in range(40)]
    r.shuffle(rows)
    schema = "sheet int, id long, x int, y int, w int, h int"
    b = spark.createDataFrame(rows, schema)
    links = B.merge_pairs(b, "sheet", "id").where("rule like 'R%'")
    want = B.united(b, links, "sheet", "id")
    got = B.merge_pass(b, "sheet", "id")
    assert got.dtypes == want.dtypes
    assert 20 < want.count() < 500 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    odd = spark.createDataFrame([[1, 9000, 5, 5, None, 9], [None, 9001, 5, 5, 9, 9], [1, None, 5, 5, 9, 9]], schema)
    alone = [tuple(x) for x in B.merge_pass(b.unionByName(odd), "sheet", "id").where("id >= 9000").orderBy("id").collect()]
    assert alone == [(1, 9000, 5, 5, None, 9, None, 1), (None, 9001, 5, 5, 9, 9, 81, 1)]
    sized = b.withColumns({"area": F.lit(7).cast("long"), "members": F.lit(2).cast("long")})
    assert B.merge_pass(sized, "sheet", "id").agg(F.sum("area"), F.sum("members")).first()[:] == (7 * len(rows), 2 * len(rows))


def test_components_of_copies_take_no_pairs():
    """So many copies that their pairs couldn't be listed."""
    import numpy as np

    from latticework.operators.tiles import components

    n = 200_000
    x = np.arange(n) % 2 * 100
    roots = components(x, x, np.full(n, 20), np.full(n, 20), np.arange(n), 20.0, 400.0, 7.0, B.MergeParams())
    assert sorted(set(roots.tolist())) == [0, 1] and (roots == np.arange(n) % 2).all()
