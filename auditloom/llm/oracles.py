"""DuckDB SQL of those queries that SQL can express."""

#: Words of white-space separated text, one row each: doc_id, i (from 1), w.
_SPACED = r"""
words as (select doc_id, generate_subscripts(ws, 1) as i, unnest(ws) as w
          from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents))"""

OP9 = f"""
with {_SPACED},
spans as (select doc_id, i, w, count(*) over following as n, string_agg(w, ' ') over following as span
          from words window following as (partition by doc_id order by i rows between current row and 34 following)),
repeats as (select span from spans where n = 35 group by span having count(*) > 1),
marked as (select s.doc_id, s.i, s.w, coalesce(max(case when s.n = 35 and r.span is not null then 1 else 0 end)
             over (partition by s.doc_id order by s.i rows between 34 preceding and current row), 0) as gone
           from spans s left join repeats r on s.span = r.span),
kept as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed,
                coalesce(string_agg(w, ' ' order by i) filter (where gone = 0), '') as rest
         from marked group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, s from (
  select doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from words where len(ws) >= 5)
  union all select doc_id, array_to_string(ws, ' ') from words where len(ws) between 1 and 4)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from common join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= 75 * (x.n + y.n - c)),
edges as (select u, v from links union select v, u from links),
reach as (select doc_id as u, doc_id as v from documents union select r.u, e.v from reach r join edges e on r.v = e.u),
least as (select u, min(v) as component_id from reach group by u)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least on least.u = d.doc_id left join sizes s on s.doc_id = d.doc_id"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
with docs as (select doc_id, coalesce({_WORDS}, []) as ws from documents),
bench as (select item_id, {_WORDS} as ws from benchmark),
windows as (select distinct item_id, least(len(ws), 8) as n, array_to_string(list_slice(ws, i, i + least(len(ws), 8) - 1), ' ') as w
            from (select item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) as i from bench where len(ws) > 0)),
sizes as (select distinct n from windows),
places as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from docs, sizes where len(ws) >= n),
hits as (select distinct p.doc_id, p.i, p.n, w.item_id
         from places p join windows w on w.n = p.n and w.w = array_to_string(list_slice(p.ws, p.i, p.i + p.n - 1), ' ')),
covered as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
          from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from docs d left join covered c on c.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id"""

OP6 = """
with recursive usable as (select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as v from usable a join usable b
  on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
counts as (select u, count(*) as n from links group by u),
reach as (select vec_id as u, vec_id as v from embeddings union select r.u, l.v from reach r join links l on r.v = l.u),
least as (select u, min(v) as component_id from reach group by u)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings e join least on least.u = vec_id left join counts c on c.u = vec_id"""
