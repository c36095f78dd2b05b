"""Queries over the driver's tables: each applies an operator to a view derived from them by integer arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polygons as O
from ..functions import scalars as S
from ..functions import texts as X
from ..operators import boxes as B
from ..operators import confidence as C
from ..operators import editor as E
from ..operators import grouping as G
from ..operators import lattice as L
from ..operators import leveling as V
from ..operators import manifest as M
from ..operators import planes as P
from ..operators import review as R
from ..operators import robust as Z
from ..operators import runs as U
from ..operators import triage as T
from ..operators.graph import connected_components
from ..sources import documents as D
from ..sources import library as Y

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SHEET, SIDE = 512, 4096
#: Pairs of boxes up to so far apart are described.
REACH = 32
#: Planes are compared within their label; bands of 16 bits.
BANDS = 4
SPEC = V.SheetSpec()


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as boxes on SHEET sheets of SIDE pixels; the id is made of the row's keys."""
    li = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("l_quantity"))
    i = lambda e: F.expr(f"cast({e} as int)")
    return li.select(
        i(f"l_orderkey % {SHEET}").alias("sheet"),
        F.expr("((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey").alias("id"),
        i(f"l_partkey * 7919 % {SIDE}").alias("x"),
        i(f"(l_suppkey * 389 + l_linenumber * 1021) % {SIDE}").alias("y"),
        i("l_quantity + 2").alias("w"),
        i("(l_partkey * 31 + l_linenumber * 9) % 48 + 3").alias("h"),
    )


def planes(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as 8x8 planes u, with hashes a and dh."""
    p = t(spark, d, "embeddings").select("vec_id", "label", P.to_u8(F.col("embedding")).alias("u"))
    nine = F.array(*[F.element_at("u", y * 8 + x * 8 // 9 + 1) for y in range(8) for x in range(9)])
    return p.withColumn("a", P.ahash(F.col("u"))).withColumn("dh", P.dhash(nine))


def icons(spark: SparkSession, d: str) -> DataFrame:
    """part as icons of brand sheets."""
    return t(spark, d, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("ink_w"), F.expr("cast(p_partkey % 40 + 1 as int)").alias("ink_h"), F.expr("(p_partkey % 7 + 1) * 0.5D").alias("stroke"), F.expr("(p_partkey % 50 + 50) / 100.0D").alias("solidity"))


def triage_events(spark: SparkSession, d: str) -> DataFrame:
    """events as review events of user sessions."""
    kind = F.expr("case event_type when 'click' then 'approve' when 'view' then 'flag' when 'purchase' then 'duplicate' when 'signup' then 'reject' else 'undo' end")
    return t(spark, d, "events").select("user_id", "event_id", "ts", kind.alias("action"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("icon"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return T.replay(triage_events(spark, d), "user_id", ["ts", "event_id"], "action", "icon", "at")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """LSH candidates with both planes."""
    p = planes(spark, d)
    found = P.lsh_candidates(p, ["label"], "vec_id", ["a", "dh"], BANDS).drop("label")
    u = p.select("vec_id", "u")
    return found.join(u.withColumnsRenamed({"vec_id": "a", "u": "ua"}), "a").join(u.withColumnsRenamed({"vec_id": "b", "u": "ub"}), "b")


def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """documents as an enriched review view."""
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1")
    clusters = docs.join(first, "h").select("doc_id", "cluster", F.col("cluster").alias("keeper"))
    out = Z.outlier_scan(docs, [], ["doc_id"], ["n_chars"]).select("doc_id", F.col("metric").alias("kind"))
    flags = t(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("low_composite").alias("kind"))
    states = t(spark, d, "labels").select("doc_id", F.expr("case when toxic = 1 then 'flagged' when quality = 0 then 'rejected' when doc_id % 3 = 0 then 'approved' else 'pending' end").alias("state"))
    return R.enrich(docs.drop("h"), "doc_id", clusters, out, states, flags)


@query
def outlier_scan(spark, d):
    return Z.outlier_scan(t(spark, d, "documents"), ["source"], ["doc_id"], ["n_chars"]).withColumn("z", S.round6("z"))


@query
def outlier_lineitem(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return Z.outlier_scan(t(spark, d, "lineitem"), ["l_returnflag"], keys, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 1.2).withColumns({"z": S.round6("z"), "median": S.round6("median")})


@query
def spread_stats(spark, d):
    long = t(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("value"))
    return Z.spread(long, ["source"]).withColumn("mean_ad", S.round6("mean_ad"))


@query
def modal_mismatch(spark, d):
    return Z.modal_mismatch(t(spark, d, "documents"), ["source"], ["doc_id"], "lang")


@query
def quality_flags(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", (F.col("quality") * 0.5 + (1 - F.col("toxic")) * 0.4).alias("composite"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("nodes"), F.col("n_chars").alias("area"), (F.col("toxic") == 0).alias("closed"))
    return rows.select("doc_id", F.array_join(S.quality_flags(F.col("composite"), F.col("nodes"), F.col("area"), F.col("closed")), ",").alias("flags")).where("flags != ''")


@query
def ahash_bits(spark, d):
    return planes(spark, d).select("vec_id", S.hex64(F.col("a")).alias("hash"))


@query
def dhash_bits(spark, d):
    return planes(spark, d).select("vec_id", S.hex64(F.col("dh")).alias("hash"))


@query
def band_keys(spark, d):
    return planes(spark, d).select("vec_id", F.explode(P.band_keys(F.col("a"), 4)).alias("k")).select("vec_id", "k.band", "k.key")


@query
def lsh_candidates(spark, d):
    return P.lsh_candidates(planes(spark, d), ["label"], "vec_id", ["a", "dh"], BANDS).drop("label")


@query
def dup_verify_iou(spark, d):
    return pairs(spark, d).select("a", "b", S.round6(P.ink_iou(F.col("ua"), F.col("ub"))).alias("iou"))


@query
def dup_ssim(spark, d):
    return pairs(spark, d).select("a", "b", S.round6(P.ssim_block(F.col("ua"), F.col("ub"))).alias("ssim"))


@query
def dup_composite(spark, d):
    u = [F.col("ua"), F.col("ub")]
    return pairs(spark, d).select("a", "b", S.round6(P.mae(*u)).alias("mae"), S.round6(S.composite(P.ssim_block(*u), P.mae(*u), P.ink_iou(*u))).alias("composite"))


@query
def cascade_funnel(spark, d):
    return R.funnel(pairs(spark, d), P.ink_iou(F.col("ua"), F.col("ub")) >= 0.5, P.ssim_block(F.col("ua"), F.col("ub")) >= 0.25)


@query
def dup_clusters(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), (F.col("n_chars") + F.col("doc_id") % 7).alias("score"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    links = docs.join(first, "h").where("doc_id != a").select("a", F.col("doc_id").alias("b"))
    return P.clusters(links, docs, "doc_id", "score").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query
def shared_part_components(spark, d):
    """Suppliers joined by parts that sell them in one order line group."""
    li = t(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    low = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"))
    return connected_components(li.join(low, "l_partkey").select("a", F.col("l_suppkey").alias("b")), "a", "b")


@query
def dedupe_import(spark, d):
    return Y.dedupe_import(t(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "content_hash", "outcome")


@query
def import_counts(spark, d):
    return Y.dedupe_import(t(spark, d, "pages"), "html", ["page_id"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def library_page(spark, d):
    return Y.page(t(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 40, 25)


@query
def virtual_window(spark, d):
    return Y.virtual_window(t(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 100, 20)


@query
def cache_latest(spark, d):
    return Y.latest(t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("payload"), F.col("ts").alias("created_at"))).select("key", "payload")


@query
def cache_key(spark, d):
    return t(spark, d, "documents").select("doc_id", Y.cache_key(F.col("text"), F.col("lang"), F.col("source")).alias("key"))


@query
def icon_ids(spark, d):
    return boxes(spark, d).select("id", Y.icon_id(F.sha2(F.col("sheet").cast("string").cast("binary"), 256), F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("icon_id"))


@query
def review_state(spark, d):
    return Y.set_state(triage_events(spark, d), "icon", "action", ["ts", "event_id"])


@query
def box_noise_filter(spark, d):
    return B.noise_filter(boxes(spark, d), "sheet", SIDE, SIDE).select("sheet", "id")


@query
def box_merge_pairs(spark, d):
    return B.merge_pairs(boxes(spark, d), "sheet", "id")


@query
def box_merge_groups(spark, d):
    return B.merge_pass(boxes(spark, d), "sheet", "id")


@query
def box_pair_geometry(spark, d):
    b = boxes(spark, d)
    p = B.near_pairs(b, "sheet", "id", REACH)
    return p.select("sheet", F.col("a_id").alias("a"), F.col("b_id").alias("b"), B.gap("a_", "b_").cast("long").alias("gap"), S.round6(B.iou("a_", "b_")).alias("iou"), B.intersects("a_", "b_").alias("meets"))


@query
def containment_parent(spark, d):
    return B.containment_parent(boxes(spark, d), "sheet", "id")


@query
def marquee_select(spark, d):
    return B.marquee(boxes(spark, d), "sheet", [(100, 100, 900, 700), (2000, 1500, 400, 900)], "id")


@query
def point_pick(spark, d):
    return B.point_pick(boxes(spark, d).withColumn("sheet", F.col("sheet") % 16), "sheet", "id", 1200, 1030)


@query
def reading_rows(spark, d):
    return B.reading_rows(boxes(spark, d), "sheet", "id").select("sheet", "id", "row_no")


@query
def rle_runs(spark, d):
    return U.plane_runs(t(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], "embedding", 8)


@query
def rle_components(spark, d):
    r = rle_runs(spark, d).withColumn("run", F.expr("vec_id * 64 + y * 8 + x_start"))
    return U.run_components(r, ["vec_id"], "run", 4)


@query
def plane_round_trip(spark, d):
    back = U.runs_plane(rle_runs(spark, d), ["vec_id"], 8, 8)
    return back.select("vec_id", F.array_join(F.col("plane").cast("array<string>"), "").alias("bits"))


@query
def ink_profile(spark, d):
    return L.profile(boxes(spark, d), "sheet")


@query
def valleys(spark, d):
    return L.valleys(L.profile(boxes(spark, d), "sheet"), "sheet")


@query
def regularity(spark, d):
    return L.regularity(L.valleys(L.profile(boxes(spark, d), "sheet"), "sheet"), "sheet").withColumn("regularity", S.round6("regularity"))


@query
def grid_classify(spark, d):
    b = boxes(spark, d)
    x, y = L.valleys(L.profile(b, "sheet"), "sheet"), L.valleys(L.profile(b, "sheet", "y", "h", "w"), "sheet")
    return L.classify(b, x, y, "sheet").select("sheet", "id", "col", "row", "axes")


@query
def confidence_score(spark, d):
    b = boxes(spark, d)
    merges = B.merge_pairs(b, "sheet", "id").where("rule like 'R%'").groupBy("sheet").agg(F.count(F.lit(1)).alias("merges"))
    reg = L.regularity(L.valleys(L.profile(b, "sheet"), "sheet"), "sheet").select("sheet", F.col("regularity").alias("reg_x"), F.col("n_valleys").alias("n_x"))
    ev = b.groupBy("sheet").agg(F.sum((F.col("w") >= 50).cast("int")).alias("warnings"), (F.min("x") / 100.0).alias("consensus"))
    ev = ev.join(merges, "sheet", "left").join(reg, "sheet", "left").withColumns({"reg_y": F.lit(None).cast("double"), "n_y": F.lit(None).cast("int"), "kind": F.when(F.col("sheet") % 16 == 0, "otsu").when(F.col("sheet") % 16 == 1, "kmeans").otherwise("border")})
    out = C.score(b, "sheet", SIDE, SIDE, ev)
    return out.select("sheet", "n", *[S.round6(c).alias(c) for c in (*C.WEIGHTS, "score")])


@query
def level_icons(spark, d):
    out = V.level(V.grid_layout(icons(spark, d), "sheet", ["id"], SPEC), "sheet", SPEC)
    return out.select("sheet", "id", *[S.round6(c).alias(c) for c in ("scale", "x", "y")], "flags")


@query
def level_report(spark, d):
    out = V.report(V.level(V.grid_layout(icons(spark, d), "sheet", ["id"], SPEC), "sheet", SPEC), "sheet")
    return out.select("sheet", *[S.round6(c).alias(c) for c in ("ink_size_cv", "stroke_cv", "baseline_spread")], "overflows", "stroke_clamped", "solidity_clamped")


@query
def grid_layout(spark, d):
    return V.grid_layout(icons(spark, d), "sheet", ["id"], SPEC).select("sheet", "id", "col", "row", "cell_x", "cell_y")


@query
def sheet_size(spark, d):
    return V.sheet_size(icons(spark, d), "sheet", SPEC)


@query
def grid_position(spark, d):
    return icons(spark, d).select("id", V.grid_position(F.col("id") + 1, 7).alias("p")).select("id", "p.row", "p.col")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The leveled icons of the brand sheets as manifest rows."""
    out = V.level(V.grid_layout(icons(spark, d), "sheet", ["id"], SPEC), "sheet", SPEC)
    names = F.array(*[F.lit(p[0]) for p in X.PRESETS])
    out = out.withColumns({"index": F.col("index") + 1, "stem": F.col("sheet"), "preset": F.element_at(names, (F.col("id") % 7 + 1).cast("int")), "colours": F.col("id") % 5 + 1, "area": F.floor(F.col("ink_w") * F.col("ink_h") * F.col("solidity") + 0.5).cast("long") * (F.col("id") % 9 != 0).cast("int"), "id_hex": F.lpad(F.lower(F.hex("id")), 32, "0")})
    return M.rows(out, SPEC.columns, "{sheet}-{index:03}-{row}{nope}{preset}")


@query
def manifest_rows(spark, d):
    return manifest(spark, d).drop("position")


@query
def manifest_csv(spark, d):
    return M.to_csv(manifest(spark, d), ["index", " Name", "TAGS", "file", "ink", "id"], ";")


@query
def missing_artwork(spark, d):
    """Icons of the part table whose number no line item has."""
    art = t(spark, d, "lineitem").select(F.col("l_partkey").alias("id"))
    return M.missing_artwork(icons(spark, d).select("id", "sheet"), art, "id")


@query
def review_texts(spark, d):
    """The texts of a review, of each part as an icon."""
    r = icons(spark, d)
    i, w, h, ms = F.col("id"), F.col("ink_w"), F.col("ink_h"), F.col("id") * 7 % 2500
    return r.select(
        "id",
        X.group_label(i, w, h).alias("label"),
        X.group_colour(i).alias("colour"),
        X.overlay_summary(i, F.col("solidity"), i % 3, ms).alias("overlay"),
        X.split_summary(i % 2 == 0, w, ms * 0.5).alias("split"),
        X.cascade_line(i * 1009, i * 31, i, i % 4).alias("cascade"),
        X.progress_line(i % 50, i, w, h, i % 5, i % 6, i % 7, S.format_bytes(i * 10)).alias("progress"),
        X.pace_line(i % 50, i, i * 1000).alias("pace"),
        S.format_ms(ms * 0.75).alias("took"),
        S.status_line(i, (i % 997) / 100, F.col("solidity"), i % 3).alias("status"),
        X.icon_key(i, w, h, i % 4, X.preset_of(F.lit("flat-8"))).alias("key"),
        X.short_hash(F.lpad(i.cast("string"), 5 + (i % 6).cast("int"), F.lit("0"))).alias("short"),
        F.array_join(X.flag_names(i % 8), ",").alias("flags"),
        X.style_class(F.col("solidity") - 0.25).alias("style"),
        X.sheet_stem(F.when(i % 3 == 0, F.lit("  ")).when(i % 3 == 1, F.concat(F.lit("own"), i)), F.concat(F.lit("/a.b/"), F.col("name"), F.lit(".png"))).alias("stem"),
        S.id_escape(F.concat(F.lit(" "), F.col("name"), F.lit("  <é> "))).alias("escaped"),
        X.pdf_string(F.concat(F.col("name"), F.lit(" (é\\\t)"))).alias("pdf"),
    )


@query
def key_intents(spark, d):
    """Key presses made of event numbers."""
    keys = ["a", "A", "r", "f", "d", "z", "Z", "e", "E", " ", "j", "ArrowUp", "Escape", "x"]
    e = t(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("event_id") % len(keys) + 1).cast("int")).alias("key"), (F.col("event_id") % 2 == 0).alias("shift"), (F.col("event_id") % 5 == 0).alias("ctrl"), (F.col("event_id") % 7 == 0).alias("alt"))
    return e.withColumn("intent", X.key_intent(*[F.col(c) for c in ("key", "shift", "ctrl", "alt")])).withColumn("parsed", T.parse_action(F.concat(F.lit(" "), F.col("key"))))


@query
def id_keys(spark, d):
    """Ids and cache keys of documents' digests."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    raw = F.unhex(F.substring("h", 1, 32))
    back = X.parse_hex32(F.when(F.col("doc_id") % 9 == 0, F.lit("no hex")).otherwise(F.concat(F.lit(" "), X.hex32(raw), F.lit("\n"))))
    seg = X.seg_key(F.lit(0.85), F.lit(12.0), F.lit(128), (F.col("doc_id") % 3).cast("int"))
    return docs.select("doc_id", X.hex32(raw).alias("id"), F.lower(F.hex(back)).alias("parsed"), F.lower(F.hex(X.session_key(raw))).alias("session"), X.mask_key(F.col("h"), seg).alias("mask"), seg.alias("seg"), X.unpack_rgba(X.pack_rgba(*[F.col("doc_id") % (k + 1) for k in (9, 99, 255, 20)])).getItem(2).alias("blue"))


@query
def box_gestures(spark, d):
    """Drags between the corners of boxes, on a preview of a third of the size."""
    x1, y1 = F.col("x") + F.col("w") - 20, F.col("y") + F.col("h") - 25
    g = boxes(spark, d).withColumn("g", X.drag_box(F.col("x") - 10, F.col("y") + 0.5, x1, y1, SIDE, SIDE)).withColumn("c", X.centre(*[F.col(k) for k in "xywh"]))
    return g.select("sheet", "id", "g.*", "c.cx", "c.cy", X.is_click(F.col("x"), F.col("y"), x1, y1).alias("click"), X.to_sheet(F.col("x"), X.preview_scale(F.lit(3), F.lit(9))).alias("sheet_x"), X.bbox(F.col("x"), F.col("y"), F.col("w") % 5, F.col("h"))["w"].alias("width"), S.round6(X.cell_transform(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(0.375))["tx"]).alias("tx"))


def shown(spark: SparkSession, d: str) -> DataFrame:
    """boxes as icons with documents, presets, scores and states, some missing or unknown."""
    some = lambda n, v: F.when(F.col("id") % n != 0, v)
    states = F.array(*[F.lit(x) for x in [*Y.REVIEW_STATES, "lost"]])
    return boxes(spark, d).withColumns({"svg": some(3, F.concat(F.lit("<svg/>"), F.col("w"))), "preset": some(4, F.lit("scan")), "ssim": some(5, F.col("w") / 64.0), "state": F.element_at(states, (F.col("id") % 6 + 1).cast("int"))})


@query
def icons_of_sheet(spark, d):
    return Y.icons_for_sheet(shown(spark, d), 7).select("id", "x", "y", "svg", "preset", "ssim")


@query
def review_states_of(spark, d):
    return Y.review_states_for(shown(spark, d), 7).select("id", "state")


@query
def audit_log(spark, d):
    return Y.log_for(t(spark, d, "events"), 5, "user_id", "event_id").select("event_id", "event_type")


@query
def library_counts(spark, d):
    return Y.counts(t(spark, d, "part").select("p_brand").distinct(), t(spark, d, "part"))


@query
def insert_icons(spark, d):
    b = boxes(spark, d).select("id", "x", "y")
    new = b.unionByName(b.withColumn("x", F.col("x") + 1))
    return Y.insert_icons(b.where("id % 2 = 0"), new)


@query
def cache_payloads(spark, d):
    """Payloads written and read back; every tenth is damaged in between."""
    rows = t(spark, d, "documents").select("doc_id", X.score_payload(F.col("text"), F.array("lang", "source"), F.col("n_chars") / 8.0).cast("binary").alias("payload"))
    packed = Y.pack_payloads(rows, "payload").withColumn("payload", F.when(F.col("doc_id") % 10 == 0, F.substring("payload", 3, 20)).otherwise(F.col("payload")))
    back = Y.unpack_payloads(packed, "payload").select("doc_id", F.col("payload").cast("string").alias("j"))
    return back.select("doc_id", F.sha2(X.cached_document(F.col("j")), 256).alias("svg"))


@query
def cache_evict(spark, d):
    return Y.evict(t(spark, d, "events"), ["user_id"], "event_id", 3).select("user_id", "event_id")


@query
def batch_summary(spark, d):
    rows = icons(spark, d).select("sheet", (F.col("id") % 6 == 0).alias("failed"), (F.col("id") % 4 == 0).alias("hit"), (F.col("stroke") / 4).alias("ssim"), F.col("solidity").alias("composite"))
    return Y.batch_summary(rows, ["sheet"]).withColumn("mean_composite", S.round6("mean_composite"))


@query
def restored_states(spark, d):
    prior = t(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").otherwise("approved").alias("state"))
    return Y.restored_states(t(spark, d, "documents").select("doc_id"), prior, "doc_id")


@query
def restored_groups(spark, d):
    """Merged groups whose box is that of an original: the ones handed back unchanged."""
    b = boxes(spark, d)
    return B.same_boxes(B.merge_pass(b, "sheet", "id"), b, "sheet").select("sheet", "id")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """boxes as the nodes of one document for each sheet."""
    from pyspark.sql import Window

    b = boxes(spark, d).withColumn("node", F.row_number().over(Window.partitionBy("sheet").orderBy("id")).cast("long"))
    real = lambda c: F.col(c).cast("double")
    identity = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    return b.select(F.col("sheet").alias("doc"), "node", (F.col("node") - 1).cast("int").alias("z"), *[real(k).alias(k) for k in "xywh"], F.when(F.col("node") % 5 == 0, F.col("node") % 3 + 1).alias("grp"), F.lit("#000000").alias("fill"), (F.col("node") % 11 != 0).alias("visible"), identity.alias("m"))


def chosen(n: DataFrame) -> DataFrame:
    return n.where("node % 4 = 1").select("doc", "node")


@query
def editor_transform(spark, d):
    n = nodes(spark, d)
    sel = chosen(n)
    out = E.rotate(E.scale(E.translate(n, sel, 3, -2), sel, 2, 0.5, (100, 50)), sel, 90, (0, 0))
    return out.select("doc", "node", "x", "y", "w", "h", F.array_join(F.transform("m", lambda v: F.floor(v * 2).cast("string")), ",").alias("m2"))


@query
def editor_align(spark, d):
    n = nodes(spark, d)
    sel = chosen(n)
    out = E.align(E.align(n, sel, "right"), sel, "vcentre", (4096, 4096))
    out = E.centre_on_canvas(out, n.where("node = 2").select("doc", "node"), 4096, 4096)
    return E.set_visible(E.set_fill(out, sel, "#ff0000"), sel, False).select("doc", "node", "x", "y", "fill", "visible")


@query
def editor_order(spark, d):
    n = nodes(spark, d)
    sel = n.where("node % 4 = 1 or node % 4 = 2").select("doc", "node")
    out = n.select("doc", "node")
    for name, moved in (("front", E.arrange(n, sel, True)), ("back", E.arrange(n, sel, False)), ("up", E.reorder(n, sel, True)), ("down", E.reorder(n, sel, False))):
        out = out.join(moved.select("doc", "node", F.col("z").alias(name)), ["doc", "node"])
    return out


@query
def editor_copies(spark, d):
    n = nodes(spark, d)
    return E.delete(E.duplicate(n, chosen(n), 4, 4), n.where("node % 3 = 0").select("doc", "node")).select("doc", "node", "z", "x", "y")


@query
def editor_groups(spark, d):
    n = nodes(spark, d)
    made = E.group(n, chosen(n))
    loose = E.ungroup(made, n.where("node = 10").select("doc", "node"))
    some = E.expand(made, n.where("node = 1").select("doc", "node")).withColumn("expanded", F.lit(True))
    return loose.select("doc", "node", "grp").join(some, ["doc", "node"], "left").withColumn("expanded", F.coalesce("expanded", F.lit(False)))


@query
def editor_selection(spark, d):
    n = nodes(spark, d)
    third = n.where("node % 3 = 0").select("doc", "node")
    return E.select_remove(E.select_add(n, E.select_toggle(chosen(n), third), n.where("node = 5").select("doc", "node")), n.where("node < 4").select("doc", "node"))


@query
def editor_hits(spark, d):
    n = nodes(spark, d)
    area = E.marquee(n, 900, 800, 100, 100).groupBy("doc").agg(F.count(F.lit(1)).alias("in_area"))
    return area.join(E.hit_test(n, 600, 700, 150), "doc", "left")


@query
def editor_snap(spark, d):
    n = nodes(spark, d)
    return E.snap(n, n.where("node < 3").select("doc", "node"), 2.0, -3.0, 4096, 4096, 512)


@query
def csv_quote(spark, d):
    return t(spark, d, "pages").select("page_id", S.csv_field(F.col("html")).alias("field"))


@query
def grades(spark, d):
    return icons(spark, d).groupBy(S.grade(F.col("solidity")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query
def hex_colours(spark, d):
    c = icons(spark, d).select("id", S.hex_rgb(F.col("id") % 256, F.col("ink_w"), F.col("ink_h")).alias("colour"))
    return c.withColumn("rgba", F.array_join(S.parse_hex_colour(F.col("colour")).cast("array<string>"), ","))


@query
def format_sizes(spark, d):
    return t(spark, d, "documents").select("doc_id", S.format_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query
def xml_text(spark, d):
    return t(spark, d, "benchmark").select("item_id", S.xml_escape(F.concat(F.lit("<a b=\"'é'\">&\n"), F.col("text"))).alias("xml"))


@query
def triage_replay(spark, d):
    return decisions(spark, d)


@query
def triage_counts(spark, d):
    return T.counts(decisions(spark, d), "user_id")


@query
def triage_csv(spark, d):
    return T.to_csv(decisions(spark, d), "user_id", "icon")


@query
def triage_states(spark, d):
    return decisions(spark, d).select("user_id", "icon", T.state_of(F.col("action")).alias("state"))


@query
def journal_parse(spark, d):
    e = triage_events(spark, d)
    lines = e.select("event_id", T.journal_line(F.col("action"), F.col("icon"), F.col("event_id"), F.col("at")).alias("line"))
    # foreign lines, fields that are missing, bad, padded and named twice
    odd = F.col("event_id") % 50
    cases = [(0, F.concat(F.lit("x"), "line")), (1, F.replace("line", F.lit(" at="), F.lit(" when="))), (2, F.replace("line", F.lit("index="), F.lit("index=-"))), (3, F.concat(F.lit("  "), F.replace("line", F.lit(" "), F.lit("   ")), F.lit("\t"))), (4, F.concat("line", F.lit(" at=7"))), (5, F.replace("line", F.lit("action=f"), F.lit("action=F")))]
    changed = F.col("line")
    for k, to in cases:
        changed = F.when(odd == k, to).otherwise(changed)
    lines = lines.withColumn("line", changed)
    return T.parse_journal(lines, "line")


@query
def journal_validate(spark, d):
    return T.validate(triage_events(spark, d).withColumn("seq", F.when(F.col("event_id") % 97 == 0, -1)), "user_id", ["ts", "event_id"], "action", "seq")


@query
def attention_order(spark, d):
    return review_rows(spark, d).select("doc_id", R.attention_rank().cast("int").alias("rank"))


@query
def filter_counts(spark, d):
    return R.filter_counts(review_rows(spark, d))


@query
def next_undecided(spark, d):
    return R.next_undecided(review_rows(spark, d), "source", ["doc_id"], "doc_id").select("doc_id", F.col("next_item"))


@query
def review_enrichment(spark, d):
    return review_rows(spark, d).select("doc_id", "cluster", "is_keeper", F.array_join("outliers", ",").alias("outliers"), F.array_join("flags", ",").alias("flags"), "state")


@query
def border_histogram(spark, d):
    return P.histogram(planes(spark, d), ["label"], "u")


@query
def otsu_threshold(spark, d):
    return P.otsu(P.histogram(planes(spark, d), ["label"], "u"), ["label"])


@query
def elbow_pick(spark, d):
    """Per return flag: the k after which the summed cost of k quantity bins bends most."""
    from pyspark.sql import Window

    li = t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    cost = li.select("l_returnflag", "q", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).groupBy("l_returnflag", "k").agg(F.sum(F.expr("q % (51 div k + 1)")).alias("c"))
    w = Window.partitionBy("l_returnflag").orderBy("k")
    bend = cost.withColumn("bend", F.lag("c").over(w) - 2 * F.col("c") + F.lead("c").over(w)).where("bend is not null")
    return bend.groupBy("l_returnflag").agg(F.max_by("k", F.struct("bend", -F.col("k"))).alias("k"))


def icon_documents(spark: SparkSession, d: str) -> DataFrame:
    """An SVG document for each part: a square and a line in a moved group; some without their end."""
    r = icons(spark, d)
    w, h = F.col("ink_w").cast("string"), F.col("ink_h").cast("string")
    fill = F.when(F.col("id") % 3 == 0, "#ff0000").otherwise("#00f")
    head = F.concat(F.lit('<svg viewBox="0 0 '), w, F.lit(" "), h, F.lit('"><title>'), S.xml_escape(F.col("name")), F.lit('</title><g transform="translate(2 1) scale(2)" fill="'), fill, F.lit('">'))
    body = F.concat(F.lit('<path d="M0 0h'), w, F.lit("v"), h, F.lit('H0z"/><path fill="#00ff0080" d="M1 1L'), w, F.lit(' 1"/></g>'))
    return r.select("id", F.concat(head, body, F.when(F.col("id") % 7 == 0, "").otherwise("</svg>")).alias("doc"))


@query
def svg_documents(spark, d):
    out = D.read_documents(icon_documents(spark, d), "doc")
    return out.select("id", "width", "height", "fills", "nodes", "closed", F.element_at("shapes", 1)["fill"].alias("fill"), F.element_at("shapes", 1)["data"].alias("data"), F.col("error").isNotNull().alias("failed"))


@query
def sheet_svg(spark, d):
    """Each brand's sheet as one document; icons are squares of their size."""
    laid = V.level(V.grid_layout(icons(spark, d), "sheet", ["id"], SPEC), "sheet", SPEC)
    w, h = F.col("ink_w").cast("string"), F.col("ink_h").cast("string")
    art = F.array(F.struct(X.packed_fill(F.col("id")).alias("fill"), F.concat(F.lit("M0 0L"), w, F.lit(" 0L"), w, F.lit(" "), h, F.lit("Z")).alias("data")))
    return M.sheet_svg(laid.withColumn("shapes", art), V.sheet_size(icons(spark, d), "sheet", SPEC))


@query
def polygon_areas(spark, d):
    """Areas of what two overlapping boxes have together, alone and in common."""
    p = B.near_pairs(boxes(spark, d), "sheet", "id", 0).where(B.intersects("a_", "b_"))
    corner = lambda side, x, y: F.struct((F.col(f"{side}_x") + x * F.col(f"{side}_w")).cast("double").alias("x"), (F.col(f"{side}_y") + y * F.col(f"{side}_h")).cast("double").alias("y"))
    ring = lambda side: F.array(F.array(*[corner(side, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]))
    out = p.select("sheet", F.col("a_id").alias("a"), F.col("b_id").alias("b"), ring("a").alias("left"), ring("b").alias("right"))
    return O.area_columns(out, "left", "right", ("union", "subtract", "intersect", "exclude"))


@query
def mask_samples(spark, d):
    """Samples of thresholded planes at places made of their numbers, some beyond the plane."""
    p = planes(spark, d).select("vec_id", F.transform("u", lambda v: (v >= 128).cast("int")).alias("m"), (F.col("vec_id") % 10 - 1).cast("int").alias("x"), (F.col("vec_id") % 9).cast("int").alias("y"))
    return p.select("vec_id", U.mask_get(F.col("m"), F.col("x"), F.col("y"), 8, 8).alias("bit"))


@query
def duplicate_ids(spark, d):
    """Documents in a cluster of equal texts, by position in the table of ids and back."""
    rows = t(spark, d, "documents").select("doc_id", (F.col("doc_id") * 2).cast("long").alias("place"), F.sha2("text", 256).alias("h"))
    clusters = rows.groupBy("h").agg(F.collect_set("place").alias("members")).where(F.size("members") > 1)
    return R.by_position(R.duplicate_ids(clusters, "place"), rows, "place", "doc_id").select("doc_id")


@query
def screened_icons(spark, d):
    """Why boxes can't be reviewed, on a sheet that some lie beyond."""
    b = boxes(spark, d).withColumns({"document": F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 5 == 0, "text").otherwise("<svg/>"), "ink": F.col("id") % 6, "w": F.when(F.col("id") % 9 == 0, 0).otherwise(F.col("w"))})
    return R.screened(b, 4100, 4090).groupBy("sheet", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def truth_matches(spark, d):
    """Boxes against themselves, moved and grown a little: which still match."""
    b = boxes(spark, d)
    i = F.col("id")
    moved = b.withColumns({"x": F.col("x") + (i % 4 - 1).cast("int"), "y": F.col("y") + (i % 3 - 1).cast("int"), "w": F.col("w") + (i % 4).cast("int")})
    return G.truth_matches(moved, b, "sheet", "id").withColumn("coverage", S.round6("coverage"))


@query
def selection_bounds(spark, d):
    n = nodes(spark, d)
    return E.bounds(n, chosen(n))
