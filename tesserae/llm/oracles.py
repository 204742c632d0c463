"""DuckDB SQL for the queries that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UP}', '{LOW}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules(rule_host, rule_path, verdict) as (values
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits as (
  select p.page_id, p.host, p.path, r.rule_host || r.rule_path as rule, r.verdict,
         row_number() over (partition by p.page_id, p.host, p.path order by length(r.rule_host || r.rule_path) desc, r.verdict) as n
  from (select distinct page_id, host, path from parts) p join rules r
    on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on f.n = 1 and f.page_id is not distinct from p.page_id and f.host = p.host and f.path = p.path
"""

OP7 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked as (
  select *, replace(replace(text, '\', '\\'), '<|', '<\|') as safe,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') as safe_role
  from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>' || safe_role || chr(10) || safe || '<|im_end|>' || chr(10)))::bigint as formatted_chars
from marked group by conv_id
"""

_WORDS = rf"regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as ws from documents),
b as (select item_id::varchar as item, {_WORDS} as ws from benchmark where text is not null and item_id is not null),
win as (
  select item, 10 as k, array_to_string(ws[i:i + 9], ' ') as s from b, unnest(generate_series(1, len(ws) - 9)) t(i) where len(ws) >= 10
  union select item, len(ws), array_to_string(ws, ' ') from b where len(ws) between 1 and 9),
occ as (
  select d.rid, t.i, ks.k, array_to_string(d.ws[t.i:t.i + ks.k - 1], ' ') as s
  from d cross join (select distinct k from win) ks, unnest(generate_series(1, len(d.ws) - ks.k + 1)) t(i)),
hit as (select occ.rid, occ.i, occ.k, win.item from occ join win on occ.k = win.k and occ.s = win.s),
cover as (select rid, count(distinct p) as n_hit from hit, unnest(generate_series(i, i + k - 1)) t(p) group by 1),
found as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct rid, item from hit) group by 1)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items,
       sha256(coalesce(f.names, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join cover c using (rid) left join found f using (rid)
"""

OP3 = rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as sh from d, unnest(generate_series(1, len(ws) - 4)) t(i) where len(ws) >= 5
  union all select doc_id, array_to_string(ws, ' ') from d where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
edge as (select u, v from common join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
reach(u, v) as (select u, v from edge union select r.u, e.v from reach r join edge e on r.v = e.u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce((select min(v) from reach where reach.u = d.doc_id), d.doc_id)) as component_id
from d left join n using (doc_id)
"""

ORACLES = {"op3_ngram_jaccard_join": OP3, "op4_benchmark_decontamination": OP4, "op1_url_filters": OP1, "op7_chat_formatting": OP7}
