"""DuckDB SQL of the queries over manifests, review texts, library tables and editor documents."""

from __future__ import annotations

from .oracles import BOXES, EVENTS, ICONS, LEVEL, MERGE

MANIFEST = (
    LEVEL
    + """, pres as (select unnest(['mono-fast', 'mono-clean', 'scan', 'flat-8', 'flat-cutout', 'detailed', 'pixel-art']) preset, unnest(range(7)) k),
man as (select sheet, idx + 1 i, id, nm, ink_w, ink_h, stroke, solidity, scale, preset, round(ink_w * ink_h * solidity)::bigint * (id % 9 <> 0)::int area from fin join pres on k = id % 7),
named as (select *, sheet || '-' || lpad(i::varchar, cast(greatest(3, length(i::varchar)) as int), '0') || '-' || ((i - 1) // 16 + 1)::varchar || '{nope}' || preset as nn from man),
slugged as (select *, trim(regexp_replace(lower(nn), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') slug from named),
texts as (select sheet, i, i::varchar as "index", nn as "name", slug,
 (case when solidity >= 0.85 then 'solid' when solidity <= 0.6 then 'hollow' else 'mixed' end) || (case when stroke / greatest(ink_w, ink_h, 1) <= 0.15 then ' thin' when stroke / greatest(ink_w, ink_h, 1) >= 0.3 then ' thick' else ' even' end) || (case when area = 0 then ' empty ' else ' ink ' end) || preset tags,
 'svg/' || slug || '.svg' as "file", ((i - 1) // 16 + 1)::varchar as "row", ((i - 1) % 16 + 1)::varchar as "col", greatest(ink_w, 1)::varchar width, greatest(ink_h, 1)::varchar height,
 regexp_replace(regexp_replace(printf('%.3f', scale * greatest(ink_w, ink_h)), '0+$', ''), '\\.$', '') ink, regexp_replace(regexp_replace(printf('%.3f', stroke), '0+$', ''), '\\.$', '') stroke,
 regexp_replace(regexp_replace(printf('%.3f', solidity), '0+$', ''), '\\.$', '') solidity, area::varchar area, preset, (id % 5 + 1)::varchar colours, lpad(lower(to_hex(id)), 32, '0') id from slugged)"""
)

SHOWN = BOXES + """, states as (select unnest(['pending', 'approved', 'rejected', 'flagged', 'duplicate', 'lost']) state, unnest(range(6)) k),
shown as (select boxes.*, case when id % 3 <> 0 then '<svg/>' || w::varchar end svg, case when id % 4 <> 0 then 'scan' end preset, case when id % 5 <> 0 then w / 64.0::double end ssim, state from boxes join states on k = id % 6)"""

NODES = BOXES + """, nodes as (select sheet doc, row_number() over (partition by sheet order by id) node, x::double x, y::double y, w::double w, h::double h from boxes),
n as (select *, (node - 1)::int z, case when node % 5 = 0 then node % 3 + 1 end grp, node % 11 <> 0 visible, node % 4 = 1 sel from nodes)"""

FMT_BYTES = "case when {n} < 1024 then printf('%.0f B', {n}) when {n} < 1048576 then printf('%.1f kB', round({n} / 1024, 1)) else printf('%.1f MB', round({n} / 1048576, 1)) end"

MORE = {
    "manifest_rows": f"with {MANIFEST} select * exclude (i) from texts",
    "manifest_csv": f"""with {MANIFEST}, lines as (select sheet, i, concat_ws(';', "index", "name", tags, "file", ink, id) || chr(13) || chr(10) l from texts)
 select sheet, 'index;name;tags;file;ink;id' || chr(13) || chr(10) || string_agg(l, '' order by i) csv from lines group by 1""",
    "missing_artwork": f"with {ICONS} select id, sheet from icons where id not in (select l_partkey from lineitem)",
    "review_texts": f"""with {ICONS}, r as (select *, id * 7 % 2500 ms from icons) select id, id::varchar || ' · ' || ink_w::varchar || '×' || ink_h::varchar "label", printf('hsl(%.1f 70%% 58%%)', (id * 137.508::double) % 360) colour,
 id::varchar || ' icons · ' || floor(solidity * 100 + 0.5)::int::varchar || '% confidence · ' || (case id % 3 when 0 then 'none need review' else (id % 3)::varchar || ' need review' end) || ' · ' || ms::varchar || ' ms' overlay,
 case when id % 2 = 0 then 'Split Here: ' || ink_w::varchar || ' regions' else 'Split Here: refused (no watershed structure)' end || printf(' · %.2f ms', ms * 0.5::double) split,
 format('{{:,}}', id * 1009) || ' band pairs → ' || format('{{:,}}', id * 31) || ' verified → ' || format('{{:,}}', id) || ' confirmed (' || (case when id % 4 > 0 then printf('%.2f× icons', round(id * 31 / (id % 4)::double, 2)) else '—' end) || ')' as "cascade",
 (id % 50)::varchar || ' of ' || id::varchar || ' decided · ' || (ink_w + id % 7)::varchar || ' approved · ' || ink_h::varchar || ' rejected · ' || (id % 5)::varchar || ' flagged · ' || (id % 6)::varchar || ' duplicate · export ' || {FMT_BYTES.format(n="(id * 10)::double")} progress,
 printf('%.1f min projected, ', round(p / 60000, 1)) || case when p <= 1200000 then 'within budget' else 'over budget' end pace,
 case when ms * 0.75 < 1000 then printf('%.1f ms', round(ms * 0.75::double, 1)) else printf('%.1f s', round(ms * 0.75::double / 1000, 1)) end took,
 'Grouped ' || id::varchar || printf(' icons in %.2f s · confidence ', (id % 997) / 100::double) || round(solidity * 100)::int::varchar || '% · ' || (case id % 3 when 0 then 'no groups need review' when 1 then '1 group needs review' else '2 groups need review' end) status,
 concat_ws(',', id::varchar, ink_w::varchar, ink_h::varchar, (id % 4)::varchar) || '@balanced' as "key",
 case when len(s) <= 8 then s else left(s, 4) || '…' || right(s, 4) end short,
 concat_ws(',', case when id % 2 = 1 then 'overflow' end, case when id % 8 in (2, 3, 6, 7) then 'stroke_clamped' end, case when id % 8 > 3 then 'solidity_clamped' end) flags, case when solidity - 0.25::double >= 0.5 then 'filled' else 'outline' end as "style",
 case id % 3 when 1 then 'own' || id::varchar else nm end stem, replace(nm, ' ', '-') || '-&lt;&#xE9;&gt;' escaped, nm || ' \\(?\\\\ \\)' pdf
 from (select *, lpad(id::varchar, (5 + id % 6)::int, '0') s, case when id % 50 > 0 then id * 1000 / (id % 50)::double else 0 end * greatest(id, id % 50) p from r)""",
    "key_intents": """with e as (select event_id, ['a', 'A', 'r', 'f', 'd', 'z', 'Z', 'e', 'E', ' ', 'j', 'ArrowUp', 'Escape', 'x'][event_id % 14 + 1] as "key", event_id % 2 = 0 as "shift", event_id % 5 = 0 ctrl, event_id % 7 = 0 alt from events)
 select *, case when ctrl and lower("key") = 'z' then 'undo' when ctrl or alt then null when "key" = ' ' then 'overlay' when "key" = 'j' then 'next' when "key" = 'ArrowUp' then 'previous' when "key" = 'Escape' then 'dismiss' when "shift" and lower("key") = 'e' then 'export'
 when "shift" then case when lower("key") = 'a' then 'bulk-approve' end else case lower("key") when 'a' then 'approve' when 'r' then 'reject' when 'f' then 'flag' when 'd' then 'duplicate' end end intent, case lower("key") when 'a' then 'approve' when 'r' then 'reject' when 'f' then 'flag' when 'd' then 'duplicate' end parsed from e""",
    "id_keys": """with d as (select doc_id, sha256(text) h, 'bgs0.85de12.0a128cp' || (doc_id % 3)::varchar seg from documents)
 select doc_id, left(h, 32) id, case when doc_id % 9 <> 0 then left(h, 32) end parsed, '52' || left(h, 32) "session", left(h, 16) || '-' || left(sha256(seg), 16) || '-v1' mask, seg, (doc_id % 256)::int blue from d""",
    "box_gestures": f"""with {BOXES}, g as (select *, x + w - 20 x1, y + h - 25 y1, x - 10 x0, y + 0.5::double y0 from boxes), c as (select *, greatest(0, least(x0, x1)) l, greatest(0, least(y0, y1)) t, least(4096, greatest(x0, x1)) r, least(4096, greatest(y0, y1)) b from g)
 select sheet, id, floor(l + 0.5)::int x, floor(t + 0.5)::int y, greatest(1, floor(r - l + 0.5)::int) w, greatest(1, floor(b - t + 0.5)::int) h, x + w / 2 cx, y + h / 2 cy, abs(x1 - x) <= 4 and abs(y1 - y) <= 4 click, floor(x / (3 / 9::double) + 0.5)::int sheet_x, case when w % 5 > 0 then w % 5 end width, round(x - 0.375::double * w, 6) tx from c""",
    "icons_of_sheet": f"with {SHOWN} select id, x, y, coalesce(svg, '') svg, coalesce(preset, '') preset, coalesce(ssim, 0.0::double) ssim from shown where sheet = 7",
    "review_states_of": f"with {SHOWN} select id, state from shown where sheet = 7 and state <> 'lost'",
    "audit_log": "select event_id, event_type from events where user_id = 5",
    "library_counts": "select (select count(distinct p_brand) from part) sheets, (select count(*) from part) icons",
    "insert_icons": f"with {BOXES} select id, x, y, 'pending' state from boxes where id % 2 <> 0",
    "cache_payloads": "select doc_id, case when doc_id % 10 <> 0 then sha256(text) end svg from documents",
    "cache_evict": "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 3",
    "batch_summary": f"with {ICONS} select sheet, count(*) filter (id % 6 <> 0) ok, count(*) filter (id % 6 = 0) failed, count(*) filter (id % 6 <> 0 and id % 4 = 0) hits, coalesce(min(stroke / 4) filter (id % 6 <> 0), 1.0::double) min_ssim, coalesce(min(solidity) filter (id % 6 <> 0), 1.0::double) min_composite, round(coalesce(avg(solidity) filter (id % 6 <> 0), 1.0::double), 6) mean_composite from icons group by 1",
    "restored_states": "select doc_id, case when toxic = 1 then 'flagged' when toxic = 0 then 'approved' else 'pending' end state from documents left join labels using (doc_id)",
    "restored_groups": f"""with recursive {MERGE}, e as (select a u, b v from rules where "rule" like 'R%' union all select b, a from rules where "rule" like 'R%'),
 reach as (select id node, id r from boxes union select e.v, reach.r from reach join e on e.u = reach.node), root as (select node, min(r) r from reach group by 1),
 merged as (select sheet, r id, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from boxes join root on node = id group by sheet, r) select sheet, id from merged m where exists (select 1 from boxes b where b.sheet = m.sheet and b.x = m.x and b.y = m.y and b.w = m.w and b.h = m.h)""",
    "editor_transform": f"""with {NODES}, s as (select *, 100 + (x + 3 - 100) * 2 x2, 50 + (y - 2 - 50) * 0.5 y2, w * 2 w2, h * 0.5 h2 from n)
 select doc, node, case when sel then -(y2 + h2 / 2) - h2 / 2 else x end x, case when sel then x2 + w2 / 2 - w2 / 2 else y end y, case when sel then h2 else w end w, case when sel then w2 else h end h, case when sel then '0,4,-1,0,-48,-188' else '2,0,0,2,0,0' end m2 from s""",
    "editor_align": f"""with {NODES}, b as (select doc, max(x + w) e from n where sel group by 1), a as (select n.*, case when sel then e - w else x end ax, case when sel then 2048 - h / 2 else y end ay from n left join b using (doc))
 select doc, node, case when node = 2 then 2048 - w / 2 else ax end x, case when node = 2 then 2048 - h / 2 else ay end y, case when sel then '#ff0000' else '#000000' end fill, visible and not sel visible from a""",
    "editor_order": f"""with {NODES}, s as (select *, node % 4 in (1, 2) o from n), m as (select *, max(node) over (partition by doc) last from s)
 select doc, node, (row_number() over (partition by doc order by o, z) - 1)::int front, (row_number() over (partition by doc order by not o, z) - 1)::int back,
 case when o then case when node // 4 * 4 + 3 <= last then z + 1 else z end when node % 4 = 3 then z - 2 else z end up, case when o then case when node > 2 then z - 1 else z end when node % 4 = 0 and node + 1 <= last then z + (case when node + 2 <= last then 2 else 1 end) else z end down from m""",
    "editor_copies": f"""with {NODES}, m as (select *, max(node) over (partition by doc) last from n), c as (select doc, last + row_number() over (partition by doc order by z) node, (last - 1 + row_number() over (partition by doc order by z))::int z, x + 4 x, y + 4 y from m where sel)
 select doc, node, z, x, y from n where node % 3 <> 0 union all select * from c where not exists (select 1 from n where n.doc = c.doc and n.node = c.node and n.node % 3 = 0)""",
    "editor_groups": f"""with {NODES}, made as (select *, case when sel then (select coalesce(max(grp), 0) + 1 from n k where k.doc = n.doc) else grp end g from n), gone as (select doc, g from made where node = 10 and g is not null)
 select m.doc, node, case when gone.g is null then m.g end grp, coalesce(m.g = (select k.g from made k where k.doc = m.doc and k.node = 1), false) expanded from made m left join gone on gone.doc = m.doc and gone.g = m.g""",
    "editor_selection": f"""with {NODES}, t as (select doc, node from n where sel <> (node % 3 = 0)), f as (select doc, grp from n where node = 5),
 a as (select doc, node from t union select n.doc, n.node from n join f on f.doc = n.doc and n.grp = f.grp union select doc, node from n where node = 5) select doc, node from a where node >= 4""",
    "editor_hits": f"""with {NODES}, a as (select doc, count(*) in_area from n where visible and x + w >= 100 and x <= 900 and y + h >= 100 and y <= 800 group by 1),
 t as (select doc, max(node) node from n where visible and x - 150 <= 600 and x + w + 150 >= 600 and y - 150 <= 700 and y + h + 150 >= 700 group by 1) select doc, in_area, node from a left join t using (doc)""",
    "editor_snap": f"""with {NODES}, b as (select doc, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 from n where node < 3 group by 1), o as (select * from n where node >= 3 and visible),
 tx as (select doc, 0 kind, x line from o union all select doc, 0, x + w from o union all select doc, 1, x + w / 2 from o union all select doc, 2, l from b, (values (0.0::double), (2048.0), (4096.0)) v(l) union all select doc, 3, l * 512.0::double from b, range(9) r(l)),
 ty as (select doc, 0 kind, y line from o union all select doc, 0, y + h from o union all select doc, 1, y + h / 2 from o union all select doc, 2, l from b, (values (0.0::double), (2048.0), (4096.0)) v(l) union all select doc, 3, l * 512.0::double from b, range(9) r(l)),
 ex as (select doc, 0 e, x0 + 2 p from b union all select doc, 1, (x0 + x1) / 2 + 2 from b union all select doc, 2, x1 + 2 from b), ey as (select doc, 0 e, y0 - 3 p from b union all select doc, 1, (y0 + y1) / 2 - 3 from b union all select doc, 2, y1 - 3 from b),
 fx as (select doc, arg_min(line - p, struct_pack(a := abs(line - p), k := kind, e := e, l := line)) d from tx join ex using (doc) where abs(line - p) <= 6 group by 1), fy as (select doc, arg_min(line - p, struct_pack(a := abs(line - p), k := kind, e := e, l := line)) d from ty join ey using (doc) where abs(line - p) <= 6 group by 1)
 select doc, 2 + coalesce(fx.d, 0) dx, -3 + coalesce(fy.d, 0) dy from b left join fx using (doc) left join fy using (doc)""",
    "svg_documents": f"""with {ICONS} select id, case when ok then ink_w::double end width, case when ok then ink_h::double end height, case when ok then 2::int end fills, case when ok then 4::int end nodes, case when ok then false end closed,
 case when ok then case when id % 3 = 0 then '#ff0000ff' else '#0000ffff' end end fill, case when ok then 'M2 1 L' || (2 + 2 * ink_w)::varchar || ' 1 L' || (2 + 2 * ink_w)::varchar || ' ' || (1 + 2 * ink_h)::varchar || ' L2 ' || (1 + 2 * ink_h)::varchar || ' Z' end "data", not ok failed from (select *, id % 7 <> 0 ok from icons)""",
    "sheet_svg": f"""with {LEVEL}, g as (select sheet, idx, '<g transform="translate(' || regexp_replace(regexp_replace(printf('%.3f', round(px, 9)), '0+$', ''), '\\.$', '') || ',' || regexp_replace(regexp_replace(printf('%.3f', round(py, 9)), '0+$', ''), '\\.$', '') || ') scale(' || regexp_replace(regexp_replace(printf('%.3f', round(scale, 9)), '0+$', ''), '\\.$', '') || ')"><path d="M0 0L' || ink_w::varchar || ' 0L' || ink_w::varchar || ' ' || ink_h::varchar || 'Z" fill="#' || lpad(lower(to_hex(id % 16777216)), 6, '0') || '"/></g>' || chr(10) g, n from fin),
 s as (select sheet, cast(least(16, n) as int) c, cast(ceil(n / least(16, n)) as int) r, string_agg(g, '' order by idx) body from g group by sheet, n), z as (select *, c * 64 + (c - 1) * 8 + 16 w, r * 64 + (r - 1) * 8 + 16 h from s)
 select sheet, '<svg xmlns="http://www.w3.org/2000/svg" width="' || w::varchar || '" height="' || h::varchar || '" viewBox="0 0 ' || w::varchar || ' ' || h::varchar || '">' || chr(10) || body || '</svg>' || chr(10) svg from z""",
    "polygon_areas": f"""with {BOXES}, p as (select p.sheet, p.id a, q.id b, (least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * (least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) i, p.w * p.h aa, q.w * q.h ba from boxes p join boxes q on p.sheet = q.sheet and p.id < q.id and p.x < q.x + q.w and q.x < p.x + p.w and p.y < q.y + q.h and q.y < p.y + p.h)
 select sheet, a, b, (aa + ba - i)::double union_area, (aa - i)::double subtract_area, i::double intersect_area, (aa + ba - 2 * i)::double exclude_area from p""",
    "mask_samples": "select vec_id, case when vec_id % 10 between 1 and 8 and vec_id % 9 < 8 then case when floor(embedding[(vec_id % 9) * 8 + vec_id % 10]::double * 256) + 128 >= 128 then 1 else 0 end else 0 end::int bit from embeddings",
    "duplicate_ids": "select doc_id from documents where text in (select text from documents group by 1 having count(*) > 1)",
    "screened_icons": f"""with {BOXES}, b as (select sheet, x, y, h, id, case when id % 9 = 0 then 0 else w end w from boxes)
 select sheet, reason, count(*) n from (select sheet, case when w = 0 then 'empty box' when id % 4 = 0 then 'no document' when x + w > 4100 or y + h > 4090 then 'off sheet' when id % 6 = 0 then 'no ink' when id % 5 = 0 then 'unparsable' end reason from b) group by all""",
    "truth_matches": f"""with {BOXES}, m as (select sheet, id, x + id % 4 - 1 x, y + id % 3 - 1 y, w + id % 4 w, h from boxes)
 select t.sheet, t.id truth, f.id "found", round(greatest(0, least(f.x + f.w, t.x + t.w) - greatest(f.x, t.x)) * greatest(0, least(f.y + f.h, t.y + t.h) - greatest(f.y, t.y)) / (t.w * t.h)::double, 6) coverage from boxes t join m f on f.sheet = t.sheet and abs(f.x - t.x) <= 1 and abs(f.y - t.y) <= 1 and abs(f.w - t.w) <= 2 and abs(f.h - t.h) <= 2""",
    "selection_bounds": f"with {NODES} select doc, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 from n where sel group by 1",
}
