"""DuckDB SQL of the training-data queries that SQL can express, written apart from their Spark form."""

from __future__ import annotations

# Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"

DOCS = f"docs as (select row_number() over () r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{WORD}') ws from documents)"

GRAMS = f"""{DOCS}, toks as (select r, unnest(ws) w, generate_subscripts(ws, 1) i from docs),
g as (select r, i, w, lag(w) over (partition by r order by i) v, lag(w, 2) over (partition by r order by i) u from toks),
c1 as (select w, count(*) c from g group by all), o1 as (select r, w, count(*) c from g group by all),
c2 as (select v, w, count(*) c from g where i > 1 group by all), o2 as (select r, v, w, count(*) c from g where i > 1 group by all),
c3 as (select u, v, w, count(*) c from g where i > 2 group by all), o3 as (select r, u, v, w, count(*) c from g where i > 2 group by all),
n1 as (select r, w, c1.c - o1.c c from o1 join c1 using (w)), n2 as (select r, v, w, c2.c - o2.c c from o2 join c2 using (v, w)), n3 as (select r, u, v, w, c3.c - o3.c c from o3 join c3 using (u, v, w)),
seen as (select g.r, g.i, n1.c w, n2.c vw, n3.c uvw, x.c v, y.c uv from g join n1 on n1.r = g.r and n1.w = g.w left join n2 on n2.r = g.r and n2.v = g.v and n2.w = g.w left join n3 on n3.r = g.r and n3.u = g.u and n3.v = g.v and n3.w = g.w
 left join n1 x on x.r = g.r and x.w = g.v left join n2 y on y.r = g.r and y.v = g.u and y.w = g.v),
one as (select *, case when w > 0 then w::double else 0.4::double end / greatest(1, (select count(*) from g) - len(ws)) p from seen join docs using (r)),
two as (select *, case when i = 1 then p when vw > 0 then vw::double / v else 0.4::double * p end q from one),
sums as (select r, sum(ln(case when i < 3 then q when uvw > 0 then uvw::double / uv else 0.4::double * q end)) s from two group by 1)"""

SHINGLES = f"""low as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws from documents),
sh as (select distinct r, md5(array_to_string(ws[i:i + 2], ' ')) s from (select r, ws, unnest(range(1, greatest(len(ws) - 1, 2))) i from low where len(ws) > 0)),
size as (select r, count(*) n from sh group by 1)"""

TARGETS = f"""{DOCS}, sized as (select doc_id, source, len(ws) sz, cast('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))), 1, 15) as bigint) h from docs),
src as (select source, sum(sz)::bigint ss, (row_number() over (order by source is null, source) - 1) % 3 + 1 wt from sized group by 1),
r0 as (select sum(ss) l, sum(wt) f from src)"""
# a source is held to its stop once its share passes it; every round fixes all that pass, so eight rounds settle a few dozen sources
for _k in range(1, 9):
    TARGETS += f", r{_k} as (select (select sum(ss) from src) - coalesce(sum(3 * ss) filter (3 * ss * f < l * wt), 0) l, coalesce(sum(wt) filter (not 3 * ss * f < l * wt), 1) f from src, r{_k - 1} group by r{_k - 1}.l, r{_k - 1}.f)"

SQL = {
    "op1_stupid_backoff": f"with {GRAMS} select doc_id, len(ws)::bigint n_words, round(coalesce(s, 0), 6) log_score, round(s / len(ws), 6) mean_log_score from docs left join sums using (r)",
    "op2_substring_dedup": f"""with {DOCS}, win as (select r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) h from (select r, doc_id, ws, unnest(range(1, len(ws) - 48)) i from docs where len(ws) >= 50)),
 first as (select h, min(doc_id) m from win group by 1), gone as (select distinct r, i + k i from win join first using (h), range(50) t(k) where m < doc_id),
 toks as (select r, unnest(ws) w, generate_subscripts(ws, 1) i from docs), kept as (select t.r, string_agg(w, ' ' order by t.i) s, count(*) n from toks t anti join gone on gone.r = t.r and gone.i = t.i group by 1)
 select doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(s, '')) kept_sha256 from docs left join kept using (r)""",
    "op6_ngram_jaccard": f"""with recursive {SHINGLES}, meet as (select x.r a, y.r b, count(*) k from sh x join sh y on x.s = y.s and x.r <> y.r group by all),
 link as (select a, b from meet join size p on p.r = a join size q on q.r = b where 100 * k >= 90 * (p.n + q.n - k)),
 reach as (select r node, r other from size union select node, b from reach join link on a = other), comp as (select node, min(doc_id) c from reach join low on low.r = other group by 1)
 select doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(c, doc_id) component_id from low left join size using (r) left join comp on node = low.r""",
    "op9_mixing": f"""with {TARGETS}, target as (select source, ss, case when 3 * ss * f < l * wt then (3 * ss)::double else l::double * wt::double / f::double end t from src, r8),
 per as (select *, case when ss > 0 then least(floor(t / ss), 3)::bigint else 0 end copies from target), open as (select *, greatest(0, t - copies * ss) budget from per),
 hs as (select source, h, sum(sz) w, count(*) k from sized group by all), run as (select *, coalesce(sum(w) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0) before from hs),
 edge as (select run.source, max(h) cut from run join open on run.source is not distinct from open.source where before <= budget group by 1),
 state as (select o.*, e.cut, case when w > 0 then least(floor((budget - before) * k / w + 0.5), k) else 0 end extra from open o join edge e on e.source is not distinct from o.source join run on run.source is not distinct from e.source and run.h = e.cut),
 ranked as (select *, row_number() over (partition by source, h) n from sized)
 select doc_id, sz::bigint as "size", ss source_size, t target, (sz * least(3, copies + case when h < cut or (h = cut and n <= extra) then 1 else 0 end))::bigint taken from ranked join state on state.source is not distinct from ranked.source""",
}
