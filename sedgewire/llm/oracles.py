"""SQL for the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

from sedgewire.llm.line_dedup import NEAR_WORDS
from sedgewire.llm.quality import FLOORS, GAMMA, LEAN, REACH

#: Word arrays: ASCII white space only, empty parts left out.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_COMPONENTS = "reach as (select id, id as root from node union select e.b, r.root from reach r join edge e on e.a = r.id), comp as (select id, min(root) as component_id from reach group by id)"

OP1 = f"""with recursive v as (select vec_id as id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
edge as (select p.id as a, q.id as b from v p join v q on p.label = q.label and p.id <> q.id and len(p.e) = len(q.e) where list_cosine_similarity(p.e, q.e) >= 0.98),
node as (select vec_id as id from embeddings), {_COMPONENTS}
select c.id as vec_id, (select count(*) from edge where a = c.id) as n_links, c.component_id, c.id = c.component_id as kept from comp c"""

OP3 = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and first <> page_id then first end as refers_to from f"""

OP4 = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents),
w as (select doc_id, k, {_WORDS.format('line')} as w from l), p as (select doc_id, k, w, row_number() over (order by doc_id, k) as place from w where len(w) > 0),
d as (select w, min(place) as first from p group by w),
s as (select w, first, unnest(range(0, len(w) + 1)) as gap from d where len(w) >= {NEAR_WORDS}),
v as (select w, first, gap, case when gap = 0 then w else list_concat(w[1:gap - 1], w[gap + 1:]) end as left_ from s),
n as (select distinct x.w from v x join v y on x.left_ = y.left_ and y.first < x.first and (x.gap = y.gap or x.gap = 0 or y.gap = 0)),
g as (select p.doc_id, p.k from p join d using (w) left join n on n.w = p.w where n.w is not null or p.place <> d.first),
r as (select doc_id, count(*) as n, string_agg(k::varchar, ',' order by k) as ks from g group by doc_id)
select d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(r.n, 0)::bigint as n_removed, coalesce(r.ks, '') as removed from documents d left join r using (doc_id)"""

_UPPER = "A-ZÀ-ÖØ-Þ"
OP6 = rf"""with t as (select doc_id, lang, source, coalesce(text, '') as x from documents),
w as (select *, {_WORDS.format('x')} as ws, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) - 6)) as i, ws from w), h as (select doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') as win from g),
r as (select doc_id, i from h qualify count(*) over (partition by doc_id, win) > 1), c as (select distinct doc_id, unnest(range(i, i + 8)) as at from r), rep as (select doc_id, count(*) as n from c group by doc_id),
b as (select w.doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0)::bigint as word_chars, len(regexp_extract_all(x, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls) as n_lines, len(regexp_extract_all(x, '[{_UPPER}]')) as n_upper, len(regexp_extract_all(x, '!')) as n_marks from w left join rep using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b),
m as (select doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'upper', 'marks', 'word_length']) as measure,
  unnest([n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), n_upper / greatest(word_chars, 1), n_marks / greatest(n_words, 1), word_chars / greatest(n_words, 1)]) as v from f),
k as (select *, case when v > 0 then ceil(ln(v) / ln({GAMMA!r})) end as bucket from m where not base_failed),
q as (select lang, source, measure, bucket, count(*) as n, grouping(source) as gs, grouping(lang) as gl from k group by grouping sets ((lang, source, measure, bucket), (lang, measure, bucket), (measure, bucket))),
u as (select *, sum(n) over (partition by gs, gl, lang, source, measure order by bucket asc nulls first) as upto, sum(n) over (partition by gs, gl, lang, source, measure) as total from q),
e as (select gs, gl, lang, source, measure, max(total) as total, min(case when upto >= ceil(0.25 * total) then coalesce(2 * pow({GAMMA!r}, bucket) / ({GAMMA!r} + 1), 0) end) as q1, min(case when upto >= ceil(0.75 * total) then coalesce(2 * pow({GAMMA!r}, bucket) / ({GAMMA!r} + 1), 0) end) as q3 from u group by all),
z as (select *, q3 + {REACH!r} * greatest(q3 - q1, {' '.join(['case measure'] + [f"when '{a}' then {b!r}" for a, b in FLOORS.items()] + ['end'])}) as fence from e),
o as (select m.doc_id, bool_or(m.v > (a.total * a.fence + {LEAN} * ((l.total * l.fence + {LEAN} * s.fence) / (l.total + {LEAN}))) / (a.total + {LEAN})) as outlier from m
  left join (select * from z where gs = 0) a on a.lang is not distinct from m.lang and a.source is not distinct from m.source and a.measure = m.measure
  left join (select * from z where gs = 1 and gl = 0) l on l.lang is not distinct from m.lang and l.measure = m.measure left join (select * from z where gl = 1) s on s.measure = m.measure group by m.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(outlier, false) as kept from f left join o using (doc_id)"""

OP8 = rf"""with recursive t as (select doc_id as id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
g as (select id, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i, w from t where len(w) > 0), s as (select distinct id, list_aggregate(w[i:i + 4], 'string_agg', ' ') as s from g), z as (select id, count(*) as n from s group by id),
pair as (select x.id as a, y.id as b, count(*) as shared from s x join s y on x.s = y.s and x.id <> y.id group by x.id, y.id),
edge as (select a, b from pair join z p on p.id = a join z q on q.id = b where 100 * shared >= 85 * (p.n + q.n - shared)), node as (select id from t), {_COMPONENTS}
select c.id as doc_id, coalesce(z.n, 0) as n_shingles, c.component_id, c.id = c.component_id as kept from comp c left join z using (id)"""

SQL: dict[str, str] = {"op1_embedding_dedup": OP1, "op3_warc_transactions": OP3, "op4_line_dedup": OP4, "op6_quality_rules": OP6, "op8_minhash_dedup": OP8}
