"""DuckDB SQL of the catalogue's queries, written apart from their Spark form."""

from __future__ import annotations

BOXES = """boxes as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_orderkey % 512 as int) sheet,
 ((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey id,
 cast(l_partkey * 7919 % 4096 as int) x, cast((l_suppkey * 389 + l_linenumber * 1021) % 4096 as int) y,
 cast(floor(q + 2) as int) w, cast((l_partkey * 31 + l_linenumber * 9) % 48 + 3 as int) h
 from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) q from lineitem group by all))"""

PLANES = """planes as (select vec_id, label, list_transform(embedding, lambda v: greatest(0, least(255, cast(floor(cast(v as double) * 256) as int) + 128))) u from embeddings),
hashes as (select *, cast(list_sum(list_transform(range(64), lambda k: case when u[k + 1] > list_sum(u) // 64 then cast(1 as hugeint) << k else 0 end)) as ubigint) a,
 cast(list_sum(list_transform(range(64), lambda k: case when u[k // 8 * 8 + (k % 8) * 8 // 9 + 1] > u[k // 8 * 8 + (k % 8 + 1) * 8 // 9 + 1] then cast(1 as hugeint) << k else 0 end)) as ubigint) dh from planes)"""

CAND = """bands as (select vec_id, 'a' kind, b, (a >> cast(16 * b as ubigint)) & 65535 k, label from hashes, range(4) r(b) union all select vec_id, 'd', b, (dh >> cast(16 * b as ubigint)) & 65535, label from hashes, range(4) r(b)),
cand as (select distinct p.vec_id a, q.vec_id b from bands p join bands q on p.kind = q.kind and p.b = q.b and p.k = q.k and p.label = q.label and p.vec_id < q.vec_id),
pairs as (select c.a, c.b, p.u ua, q.u ub from cand c join planes p on p.vec_id = c.a join planes q on q.vec_id = c.b)"""

IOU = "(case when list_sum(list_transform(range(1, 65), lambda i: case when ua[i] >= 128 or ub[i] >= 128 then 1 else 0 end)) = 0 then 1.0::double else list_sum(list_transform(range(1, 65), lambda i: case when ua[i] >= 128 and ub[i] >= 128 then 1 else 0 end))::double / list_sum(list_transform(range(1, 65), lambda i: case when ua[i] >= 128 or ub[i] >= 128 then 1 else 0 end)) end)"

STATS = """stats as (select a, b, ua, ub, list_sum(ua)::double / 64 ma, list_sum(ub)::double / 64 mb, list_sum(list_transform(ua, lambda v: v * v))::double / 64 saa,
 list_sum(list_transform(ub, lambda v: v * v))::double / 64 sbb, list_sum(list_transform(range(1, 65), lambda i: ua[i] * ub[i]))::double / 64 sab,
 list_sum(list_transform(range(1, 65), lambda i: abs(ua[i] - ub[i])))::double / (64 * 255) mae from pairs),
sim as (select *, (2 * ma * mb + 6.5025::double) * (2 * (sab - ma * mb) + 58.5225::double) / ((ma * ma + mb * mb + 6.5025::double) * (saa - ma * ma + sbb - mb * mb + 58.5225::double)) ssim from stats)"""

ICONS = "icons as (select p_brand sheet, p_partkey id, p_name nm, p_size ink_w, cast(p_partkey % 40 + 1 as int) ink_h, (p_partkey % 7 + 1) * 0.5::double stroke, (p_partkey % 50 + 50) / 100.0::double solidity from part)"

LAID = (
    ICONS
    + """, laid as (select *, idx % least(16, n) as col, idx // least(16, n) as rw, (idx % least(16, n)) * 72 + 8 cell_x, (idx // least(16, n)) * 72 + 8 cell_y
 from (select *, row_number() over (partition by sheet order by id) - 1 idx, count(*) over (partition by sheet) n from icons))"""
)

LEVEL = (
    LAID
    + """, med as (select sheet, median(stroke) ms, median(solidity) mo from icons group by 1),
raw as (select l.*, 38.4::double / greatest(ink_w, ink_h) fit, pow(ms / stroke, 0.35) sc, 1 + 0.06::double * (mo - solidity) so from laid l join med using (sheet)),
lev as (select *, fit * greatest(0.88::double, least(1.12::double, sc)) * greatest(0.96::double, least(1.04::double, so)) r from raw),
lv as (select *, case when r * greatest(ink_w, ink_h) > 48 then least(48.0::double / greatest(ink_w, ink_h), fit) else r end scale,
 (case when r * greatest(ink_w, ink_h) > 48 then 1 else 0 end) + (case when sc < 0.88 or sc > 1.12 then 2 else 0 end) + (case when so < 0.96 or so > 1.04 then 4 else 0 end) flags from lev),
fin as (select *, cell_x + 8 + (48 - ink_w * scale) / 2 px, cell_y + 8 + (48 - ink_h * scale) / 2 py from lv)"""
)

EVENTS = """ev as (select user_id, event_id, ts, case event_type when 'click' then 'approve' when 'view' then 'flag' when 'purchase' then 'duplicate' when 'signup' then 'reject' else 'undo' end as action,
 cast(json_extract_string(props, '$.k') as int) % 10 icon, epoch_us(ts) // 1000 at_ms from events)"""

REPLAY = (
    EVENTS
    + """, s1 as (select *, sum(case when action = 'undo' then -1 else 1 end) over w s, sum(case when action = 'undo' then 0 else 1 end) over w - 1 seq from ev window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
s2 as (select *, s - least(0, min(s) over (partition by user_id order by ts, event_id rows unbounded preceding)) depth from s1),
s3 as (select *, min(depth) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) later from s2),
dec as (select user_id, icon, action, cast(seq as bigint) seq, at_ms as "at" from s3 where action <> 'undo' and coalesce(later, depth) >= depth qualify row_number() over (partition by user_id, icon order by seq desc) = 1)"""
)

REVIEW = """docs as (select doc_id, source, n_chars, sha256(text) h from documents),
clus as (select doc_id, min(doc_id) over (partition by h) cluster, count(*) over (partition by h) c from docs qualify c > 1),
m1 as (select median(n_chars::double) m from docs), m2 as (select median(abs(n_chars - m)) mad from docs, m1),
outl as (select doc_id from docs, m1, m2 where abs(0.6745 * (n_chars - m) / mad) > 3.5),
st as (select doc_id, case when toxic = 1 then 'flagged' when quality = 0 then 'rejected' when doc_id % 3 = 0 then 'approved' else 'pending' end state from labels),
rev as (select d.doc_id, d.source, c.cluster, coalesce(c.cluster = d.doc_id, false) is_keeper, case when o.doc_id is null then '' else 'n_chars' end outliers, case when f.doc_id is null then '' else 'low_composite' end flags, coalesce(s.state, 'pending') state
 from docs d left join clus c using (doc_id) left join outl o using (doc_id) left join st s using (doc_id) left join (select distinct doc_id from labels where quality = 0) f using (doc_id))"""

MERGE = (
    BOXES
    + """, mst as (select sheet, median(h) mh, median(w::bigint * h) ma, greatest(4.0, least(40.0, 0.35::double * median(h))) g from boxes group by 1),
pr as (select p.sheet, p.id a, q.id b, g, mh, ma, greatest(p.x - (q.x + q.w), q.x - (p.x + p.w), p.y - (q.y + q.h), q.y - (p.y + p.h), 0) d,
 greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x))::bigint * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) inter,
 p.w::bigint * p.h aa, q.w::bigint * q.h ba, greatest(p.x + p.w, q.x + q.w) - least(p.x, q.x) uw, greatest(p.y + p.h, q.y + q.h) - least(p.y, q.y) uh, p.h::double / q.h ratio,
 (p.x <= q.x and p.y <= q.y and p.x + p.w >= q.x + q.w and p.y + p.h >= q.y + q.h) or (q.x <= p.x and q.y <= p.y and q.x + q.w >= p.x + p.w and q.y + q.h >= p.y + p.h) holds
 from boxes p join boxes q on p.sheet = q.sheet and p.id < q.id join mst on mst.sheet = p.sheet),
rules as (select sheet, a, b, case when holds then 'R4' when inter::double / (aa + ba - inter) > 0.25 then 'R4' when d > g then null
 when greatest(uw, uh) > 4 * least(uw, uh) then 'aspect' when uh > 1.9::double * mh then 'height' when least(aa, ba) <= 0.5 * greatest(aa, ba) then 'R1'
 when d <= 0.5 * g and ratio >= 0.6 and ratio <= 1.6 and uw::bigint * uh <= 1.75 * ma then 'R5' end as "rule" from pr)"""
)

PROFILE = """marks as (select sheet, pos, sum(d) d from (select sheet, x pos, h d from boxes union all select sheet, x + w, -h from boxes) group by 1, 2),
prof as (select sheet, pos, lead(pos) over (partition by sheet order by pos) stop, sum(d) over (partition by sheet order by pos) ink from marks),
vx as (select sheet, cast((pos + stop - 1) // 2 as int) centre from prof where ink = 0 and stop is not null)"""

REG = """steps as (select sheet, centre - lag(centre) over (partition by sheet order by centre) step from vx),
cnt as (select sheet, count(*) n_valleys, list_sort(list(step) filter (step is not null)) s from steps group by 1),
pit as (select *, s[len(s) // 2 + 1] pitch from cnt),
reg as (select sheet, n_valleys, pitch, case when n_valleys >= 2 then greatest(0.0::double, 1 - list_sort(list_transform(s, lambda v: abs(v - pitch)))[len(s) // 2 + 1]::double / pitch) else 0.0::double end regularity from pit)"""

RUNS = """px as (select vec_id, i // 8 y, i % 8 x from embeddings, range(64) r(i) where embedding[i + 1] > 0),
isl as (select *, x - row_number() over (partition by vec_id, y order by x) g from px),
runs as (select vec_id, cast(y as int) y, cast(min(x) as int) x_start, cast(max(x) + 1 as int) x_end from isl group by vec_id, y, g)"""

SQL = {
    "outlier_scan": """with s as (select source, median(n_chars::double) m from documents group by 1), d as (select doc_id, d.source, n_chars::double v, m from documents d join s using (source)),
 q as (select source, median(abs(v - m)) mad, avg(abs(v - m)) ad from d group by 1)
 select source, doc_id, 'n_chars' metric, v as "value", m as "median", round(z, 6) z from (select *, case when mad > 0 then 0.6745::double * (v - m) / mad when ad > 0 then 0.7979::double * (v - m) / ad else 0 end z from d join q using (source)) where abs(z) > 3.5""",
    "outlier_lineitem": """with long as (unpivot (select l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax from lineitem) on l_quantity, l_extendedprice, l_discount, l_tax into name metric value v),
 s as (select l_returnflag, metric, median(v) m from long group by all), d as (select * from long join s using (l_returnflag, metric)), q as (select l_returnflag, metric, median(abs(v - m)) mad, avg(abs(v - m)) ad from d group by all)
 select l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, metric, v as "value", round(m, 6) as "median", round(z, 6) z from (select *, case when mad > 0 then 0.6745::double * (v - m) / mad when ad > 0 then 0.7979::double * (v - m) / ad else 0 end z from d join q using (l_returnflag, metric)) where abs(z) > 1.2""",
    "spread_stats": "with s as (select source, median(n_chars::double) m from documents group by 1) select source, m as \"median\", median(abs(n_chars - m)) mad, round(avg(abs(n_chars - m)), 6) mean_ad from documents join s using (source) group by 1, 2",
    "modal_mismatch": """with c as (select source, lang, count(*) n from documents where lang is not null group by all), m as (select source, sum(n) t, max(n) top from c group by 1),
 mode as (select c.source, min(lang) md from c join m on c.source = m.source and n = top where top * 2 >= t group by 1) select d.source, doc_id, lang as "value", md as "mode" from documents d join mode using (source) where lang <> md""",
    "quality_flags": """select doc_id, concat_ws(',', case when q < 0.8 then 'low_composite' end, case when n_chars > 0 and nodes > 4 * sqrt(n_chars) then 'too_many_nodes' end, case when toxic <> 0 then 'open_outline' end) flags
 from (select doc_id, quality * 0.5::double + (1 - toxic) * 0.4::double q, length(text) - length(replace(text, ' ', '')) nodes, n_chars, toxic from documents join labels using (doc_id)) where q < 0.8 or (n_chars > 0 and nodes > 4 * sqrt(n_chars)) or toxic <> 0""",
    "ahash_bits": f"with {PLANES} select vec_id, lpad(lower(to_hex(a)), 16, '0') hash from hashes",
    "dhash_bits": f"with {PLANES} select vec_id, lpad(lower(to_hex(dh)), 16, '0') hash from hashes",
    "band_keys": f"with {PLANES} select vec_id, cast(b as int) band, cast((a >> cast(16 * b as ubigint)) & 65535 as bigint) as \"key\" from hashes, range(4) r(b)",
    "lsh_candidates": f"with {PLANES}, {CAND} select a, b from cand",
    "dup_verify_iou": f"with {PLANES}, {CAND} select a, b, round({IOU}, 6) iou from pairs",
    "dup_ssim": f"with {PLANES}, {CAND}, {STATS} select a, b, round(ssim, 6) ssim from sim",
    "dup_composite": f"with {PLANES}, {CAND}, {STATS} select a, b, round(mae, 6) mae, round(0.5 * ssim + 0.3::double * (1 - mae) + 0.2::double * {IOU}, 6) composite from sim",
    "cascade_funnel": f"with {PLANES}, {CAND}, {STATS} select count(*) candidates, coalesce(sum(case when {IOU} >= 0.5 then 1 else 0 end), 0)::bigint verified, coalesce(sum(case when {IOU} >= 0.5 and ssim >= 0.25 then 1 else 0 end), 0)::bigint confirmed from sim",
    "dup_clusters": "select min(doc_id) cluster, arg_min(doc_id, struct_pack(s := -(n_chars + doc_id % 7), d := doc_id)) keeper, string_agg(doc_id::varchar, ',' order by doc_id) members from documents group by text having count(*) > 1",
    "shared_part_components": """with recursive li as (select distinct l_suppkey s, l_partkey p from lineitem), few as (select p, min(s) m from li group by 1), e as (select distinct s u, m v from li join few using (p) where s <> m), both_ways as (select u, v from e union select v, u from e),
 reach as (select u node, u r from both_ways union select b.v, reach.r from reach join both_ways b on b.u = reach.node where reach.r < b.v) select node, min(r) component from reach group by 1""",
    "dedupe_import": "select doc_id, sha256(text) content_hash, case when row_number() over (partition by text order by doc_id) = 1 then 'imported' else 'duplicate' end outcome from documents",
    "import_counts": "select outcome, count(*) n from (select case when row_number() over (partition by html order by page_id) = 1 then 'imported' else 'duplicate' end outcome from pages) group by 1",
    "library_page": "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25 offset 40",
    "virtual_window": "select doc_id, n_chars, row_index from (select doc_id, n_chars, cast(row_number() over (order by n_chars desc, doc_id) - 1 as int) row_index from documents) where row_index >= 96 and row_index < 124",
    "cache_latest": 'select user_id as "key", arg_max(event_id, struct_pack(t := ts, e := event_id)) payload from events group by 1',
    "cache_key": "select doc_id, concat_ws('-', sha256(text), lang, substr(sha256(source), 1, 16), 'v1') as \"key\" from documents",
    "icon_ids": f"with {BOXES} select id, substr(sha256(concat_ws('|', sha256(sheet::varchar), x::varchar, y::varchar, w::varchar, h::varchar)), 1, 32) icon_id from boxes",
    "review_state": f"with {EVENTS} select icon, arg_max(action, struct_pack(t := ts, e := event_id)) state from ev group by 1",
    "box_noise_filter": f"""with {BOXES}, k as (select * from boxes where not (w::bigint * h < 16 or least(w, h) < 3 or greatest(w, h) > 60 * least(w, h) or w >= 0.9 * 4096 or h >= 0.9 * 4096)), m as (select sheet, median(h) mh from k group by 1)
 select k.sheet, id from k join m using (sheet) where not (w <= 0.35 * mh and h <= 0.35 * mh)""",
    "box_merge_pairs": f'with {MERGE} select sheet, a, b, "rule" from rules where "rule" is not null',
    "box_merge_groups": f"""with recursive {MERGE}, e as (select a u, b v from rules where "rule" like 'R%' union all select b, a from rules where "rule" like 'R%'),
 reach as (select id node, id r from boxes union select e.v, reach.r from reach join e on e.u = reach.node), root as (select node, min(r) r from reach group by 1)
 select sheet, r id, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h, cast(sum(w::bigint * h) as bigint) area, count(*) members from boxes join root on node = id group by sheet, r""",
    "box_pair_geometry": f"""with {BOXES} select p.sheet, p.id a, q.id b, cast(greatest(p.x - (q.x + q.w), q.x - (p.x + p.w), p.y - (q.y + q.h), q.y - (p.y + p.h), 0) as bigint) gap,
 round(i::double / (p.w * p.h + q.w * q.h - i), 6) iou, p.x < q.x + q.w and q.x < p.x + p.w and p.y < q.y + q.h and q.y < p.y + p.h meets
 from (select p, q, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) i from boxes p join boxes q on p.sheet = q.sheet and p.id < q.id and p.x - (q.x + q.w) <= 32 and q.x - (p.x + p.w) <= 32 and p.y - (q.y + q.h) <= 32 and q.y - (p.y + p.h) <= 32)""",
    "containment_parent": f"""with {BOXES} select c.sheet, c.id, arg_min(p.id, struct_pack(a := p.w * p.h, i := p.id)) parent from boxes c join boxes p on c.sheet = p.sheet and p.x <= c.x and p.y <= c.y and p.x + p.w >= c.x + c.w and p.y + p.h >= c.y + c.h
 and (p.w > c.w or p.h > c.h) and p.w * p.h > c.w * c.h and (p.x < c.x or (p.x = c.x and p.id < c.id)) group by 1, 2""",
    "marquee_select": f"""with {BOXES} select sheet, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h, cast(sum(w::bigint * h) as bigint) area, count(*) members from boxes
 where (x < 1000 and x + w > 100 and y < 800 and y + h > 100) or (x < 2400 and x + w > 2000 and y < 2400 and y + h > 1500) group by 1 having count(*) >= 2""",
    "point_pick": f"with {BOXES} select sheet % 16 sheet, arg_min(id, struct_pack(y := y, x := x, i := id)) id from boxes where x <= 1200 and x + w > 1200 and y <= 1030 and y + h > 1030 group by 1",
    "reading_rows": f"with {BOXES} select sheet, id, cast(dense_rank() over (partition by sheet order by y) as bigint) row_no from boxes",
    "rle_runs": f"with {RUNS} select * from runs",
    "rle_components": f"""with recursive {RUNS}, r as (select *, vec_id * 64 + y * 8 + x_start id from runs), e as (select p.id u, q.id v from r p join r q on p.vec_id = q.vec_id and abs(p.y - q.y) = 1 and p.x_start <= q.x_end and q.x_start <= p.x_end),
 reach as (select id node, id c from r union select e.v, reach.c from reach join e on e.u = reach.node), root as (select node, min(c) c from reach group by 1)
 select vec_id, min(x_start) x, min(y) y, max(x_end) - min(x_start) w, max(y) - min(y) + 1 h, cast(sum(x_end - x_start) as bigint) area, arg_min(x_start, id) ox, arg_min(y, id) oy from r join root on node = id group by vec_id, c having sum(x_end - x_start) >= 4""",
    "plane_round_trip": "select vec_id, list_aggregate(list_transform(embedding, lambda v: case when v > 0 then '1' else '0' end), 'string_agg', '') bits from embeddings where len(list_filter(embedding, lambda v: v > 0)) > 0",
    "ink_profile": f"with {BOXES}, {PROFILE} select sheet, pos as \"at\", stop as \"stop\", cast(ink as bigint) ink from prof where stop is not null",
    "valleys": f"with {BOXES}, {PROFILE} select * from vx",
    "regularity": f"with {BOXES}, {PROFILE}, {REG} select sheet, n_valleys, pitch, round(regularity, 6) regularity from reg",
    "grid_classify": f"""with {BOXES}, {PROFILE}, m2 as (select sheet, pos, sum(d) d from (select sheet, y pos, w d from boxes union all select sheet, y + h, -w from boxes) group by 1, 2),
 p2 as (select sheet, pos, lead(pos) over (partition by sheet order by pos) stop, sum(d) over (partition by sheet order by pos) ink from m2), vy as (select sheet, cast((pos + stop - 1) // 2 as int) centre from p2 where ink = 0 and stop is not null),
 lx as (select sheet, list(centre) l from vx group by 1), ly as (select sheet, list(centre) l from vy group by 1)
 select b.sheet, id, cast(len(list_filter(coalesce(lx.l, []), lambda c: c <= (x + x + w) // 2)) as int) as "col", cast(len(list_filter(coalesce(ly.l, []), lambda c: c <= (y + y + h) // 2)) as int) as "row",
 (case when len(list_filter(coalesce(lx.l, []), lambda c: x <= c - 2 and x + w > c + 2)) > 0 then 1 else 0 end) + (case when len(list_filter(coalesce(ly.l, []), lambda c: y <= c - 2 and y + h > c + 2)) > 0 then 2 else 0 end) axes
 from boxes b left join lx on lx.sheet = b.sheet left join ly on ly.sheet = b.sheet""",
    "confidence_score": f"""with {MERGE}, {PROFILE}, {REG}, mg as (select sheet, count(*) merges from rules where "rule" like 'R%' group by 1),
 b0 as (select sheet, count(*) n, median(least(w, h)::double) m, sum(case when w >= 50 then 1 else 0 end) warnings, min(x) / 100.0::double consensus, avg(case when x <= 81.92 or y <= 81.92 or x + w >= 4096 - 81.92 or y + h >= 4096 - 81.92 then 1.0::double else 0 end) border_touch from boxes group by 1),
 sz as (select b.sheet, median(abs(least(w, h) - m)) mad from boxes b join b0 using (sheet) group by 1),
 sg as (select b0.sheet, n, least(1.0::double, warnings::double / n) spans, greatest(0.0::double, least(1.0::double, (coalesce(merges, 0)::double / (n + coalesce(merges, 0)) - 0.25) / 0.5)) merge_ratio,
 greatest(0.0::double, least(1.0::double, (mad / m - 0.35::double) / (0.70::double - 0.35::double))) size_mad, border_touch, (case when regularity between 0.35 and 0.75 and n_valleys >= 2 then 1 else 0 end) / 2.0::double weak_grid,
 case when b0.sheet % 16 < 2 then 1.0::double else greatest(0.0::double, least(1.0::double, (0.85::double - consensus) / 0.85::double)) end background from b0 join sz using (sheet) left join mg using (sheet) left join reg using (sheet))
 select sheet, n, round(spans, 6) spans, round(merge_ratio, 6) merge_ratio, round(size_mad, 6) size_mad, round(border_touch, 6) border_touch, round(weak_grid, 6) weak_grid, round(background, 6) background,
 round(greatest(0.0::double, least(1.0::double, 1 - (spans * 0.3::double + merge_ratio * 0.2::double + size_mad * 0.15::double + border_touch * 0.15::double + weak_grid * 0.1::double + background * 0.1::double))), 6) score from sg""",
    "level_icons": f"with {LEVEL} select sheet, id, round(scale, 6) scale, round(px, 6) x, round(py, 6) y, flags from fin",
    "level_report": f"""with {LEVEL}, rw as (select sheet, max(s) baseline_spread from (select sheet, rw, max(py + ink_h * scale) - min(py + ink_h * scale) s from fin group by 1, 2) group by 1)
 select f.sheet, round(stddev_pop(greatest(ink_w, ink_h) * scale) / avg(greatest(ink_w, ink_h) * scale), 6) ink_size_cv, round(stddev_pop(stroke) / avg(stroke), 6) stroke_cv, round(any_value(baseline_spread), 6) baseline_spread,
 sum(flags & 1)::bigint overflows, sum(flags // 2 % 2)::bigint stroke_clamped, sum(flags // 4 % 2)::bigint solidity_clamped from fin f join rw using (sheet) group by 1""",
    "grid_layout": f'with {LAID} select sheet, id, cast(col as int) as "col", cast(rw as int) as "row", cast(cell_x as int) cell_x, cast(cell_y as int) cell_y from laid',
    "sheet_size": f"""with {ICONS}, s as (select sheet, count(*) n, cast(least(16, count(*)) as int) c from icons group by 1) select sheet, n, c as "columns", cast(ceil(n / c) as int) as "rows", c * 64 + (c - 1) * 8 + 16 width, cast(ceil(n / c) as int) * 64 + (cast(ceil(n / c) as int) - 1) * 8 + 16 height from s""",
    "grid_position": 'select p_partkey id, cast(p_partkey // 7 + 1 as int) as "row", cast(p_partkey % 7 + 1 as int) as "col" from part',
    "csv_quote": """select page_id, case when f like '%,%' or f like '%"%' or f like '%' || chr(10) || '%' or f like '%' || chr(13) || '%' or f like ' %' or f like '% ' then '"' || replace(f, '"', '""') || '"' else f end field from (select page_id, html f from pages)""",
    "grades": f"with {ICONS} select case when solidity >= 0.97 then 'excellent' when solidity >= 0.92 then 'good' when solidity >= 0.85 then 'fair' else 'poor' end grade, count(*) n from icons group by 1",
    "hex_colours": f"with {ICONS} select id, printf('#%02x%02x%02x', cast(id % 256 as int), ink_w, ink_h) colour, concat_ws(',', (id % 256)::varchar, ink_w::varchar, ink_h::varchar, '255') rgba from icons",
    "format_sizes": "select doc_id, case when n < 1024 then printf('%.0f B', n) when n < 1048576 then printf('%.1f kB', round(n / 1024, 1)) else printf('%.1f MB', round(n / 1048576, 1)) end as \"size\" from (select doc_id, (n_chars * n_chars)::double n from documents)",
    "xml_text": """select item_id, list_aggregate(list_transform(string_split(regexp_replace(replace(replace(replace(replace(replace('<a b="''é''">&' || chr(10) || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), '[\\x00-\\x1F]', ' ', 'g'), ''), lambda c: case when unicode(c) > 127 then printf('&#x%X;', unicode(c)) else c end), 'string_agg', '') "xml" from benchmark""",
    "triage_replay": f'with {REPLAY} select user_id, icon, action, seq, "at" from dec',
    "triage_counts": f"""with {REPLAY}, acts(ord, action) as (values (0, 'approve'), (1, 'reject'), (2, 'flag'), (3, 'duplicate'), (4, 'bulk-approve')) select u.user_id, cast(ord as int) ord, acts.action, count(dec.user_id) n
 from (select distinct user_id from dec) u cross join acts left join dec on dec.user_id = u.user_id and dec.action = acts.action group by all""",
    "triage_csv": f"""with {REPLAY} select user_id, 'seq,id,action,at_ms' || chr(13) || chr(10) || string_agg(concat_ws(',', seq::varchar, icon::varchar, action, "at"::varchar) || chr(13) || chr(10), '' order by seq) csv from dec group by 1""",
    "triage_states": f"with {REPLAY} select user_id, icon, case action when 'approve' then 'approved' when 'reject' then 'rejected' when 'flag' then 'flagged' when 'duplicate' then 'duplicate' end state from dec",
    "journal_parse": f"""with {EVENTS}, l as (select event_id, event_id % 50 o, action, icon, at_ms, case when action = 'undo' then 'review/undo at=' || at_ms::varchar else 'review/apply action=' || action || ' index=' || icon::varchar || ' seq=' || event_id::varchar || ' at=' || at_ms::varchar end line from ev),
 m as (select *, o in (0, 1) or (action <> 'undo' and o = 2) or (action = 'flag' and o = 5) bad from l)
 select event_id, case o when 0 then 'x' || line when 1 then replace(line, ' at=', ' when=') when 2 then replace(line, 'index=', 'index=-') when 3 then '  ' || replace(line, ' ', '   ') || chr(9) when 4 then line || ' at=7' when 5 then replace(line, 'action=f', 'action=F') else line end line,
 case when bad then null when action = 'undo' then 'undo' else 'apply' end kind, case when bad or action = 'undo' then null else action end as action, case when bad or action = 'undo' then null else icon::bigint end as "index",
 case when bad or action = 'undo' then null else event_id end seq, case when bad then null when o = 4 then 7 else at_ms end as "at" from m""",
    "journal_validate": f"""with {EVENTS}, s as (select *, sum(case when action = 'undo' then -1 else 1 end) over w d, sum(case when action = 'undo' then 0 else 1 end) over w - 1 q from ev window w as (partition by user_id order by ts, event_id rows unbounded preceding))
 select user_id, min(d) < 0 undo_on_empty, coalesce(bool_or(action <> 'undo' and event_id % 97 = 0), false) seq_mismatch from s group by 1 having min(d) < 0 or coalesce(bool_or(action <> 'undo' and event_id % 97 = 0), false)""",
    "attention_order": f"with {REVIEW} select doc_id, case when cluster is not null and not is_keeper then 0 when flags <> '' then 1 when outliers <> '' then 2 when state = 'pending' then 3 else 4 end as \"rank\" from rev",
    "filter_counts": f"""with {REVIEW} select 'all' tab, count(*) n from rev union all select 'pending', count(*) from rev where state = 'pending' union all select 'done', count(*) from rev where state <> 'pending' union all select 'flagged', count(*) from rev where state = 'flagged'
 union all select 'duplicates', count(*) from rev where cluster is not null union all select 'outliers', count(*) from rev where outliers <> ''""",
    "next_undecided": f"with {REVIEW} select doc_id, min(case when state = 'pending' then doc_id end) over (partition by source order by doc_id rows between 1 following and unbounded following) next_item from rev",
    "review_enrichment": f"with {REVIEW} select doc_id, cluster, is_keeper, outliers, flags, state from rev",
    "border_histogram": f"with {PLANES} select label, bin, count(*) n from (select label, unnest(u) bin from planes) group by all",
    "otsu_threshold": f"""with {PLANES}, hist as (select label, bin, count(*) n from (select label, unnest(u) bin from planes) group by all), c as (select *, sum(n) over w cw, sum(n * bin) over w cs, sum(n) over (partition by label) cn, sum(n * bin) over (partition by label) ct from hist window w as (partition by label order by bin rows unbounded preceding)),
 v as (select label, bin, (cs * cn - ct * cw)::double * (cs * cn - ct * cw)::double / (cw * (cn - cw))::double v from c where cw < cn) select label, arg_max(bin, struct_pack(v := v, b := -bin)) threshold from v group by 1""",
    "elbow_pick": """with c as (select l_returnflag, k, sum(cast(l_quantity as bigint) % (51 // k + 1)) c from lineitem, range(1, 9) r(k) group by all), b as (select *, lag(c) over w - 2 * c + lead(c) over w bend from c window w as (partition by l_returnflag order by k))
 select l_returnflag, cast(arg_max(k, struct_pack(b := bend, k := -k)) as int) k from b where bend is not null group by 1""",
}
