"""DuckDB SQL for the operators that SQL can express, from the tables themselves: no operator's method in it."""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as materialized (select doc_id, {_ALNUM.format(_LOWER.format('text'))} as w from documents),
b as (select item_id, {_ALNUM.format(_LOWER.format('text'))} as w from benchmark where item_id is not null),
spans as materialized (
  select distinct item_id, n, key from (
    select item_id, 10 as n, array_to_string(w[k:k + 9], ' ') as key from (select item_id, w, unnest(range(1, len(w) - 8)) as k from b where len(w) >= 10)
    union all select item_id, len(w), array_to_string(w, ' ') from b where len(w) between 1 and 9)),
places as (
  select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as key
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from spans) where len(w) >= n)),
found as materialized (select doc_id, item_id, k, p.n from places p join spans s on p.n = s.n and p.key = s.key),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(k, k + n)) as place from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join items on d.doc_id = items.doc_id
"""

OP3 = f"""
with rows as materialized (select doc_id, source, len({_SPACED.format("coalesce(text, '')")}) as size, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
sizes as (select source, sum(size) as source_size from rows group by source),
weighed as (select source, cast(source_size as bigint) as source_size, cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight from sizes),
reach as (select *, source_size * 3 / weight as r from weighed),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from reach),
goals as (select source, source_size, case when r <= top then cast(source_size * 3 as double) else top * weight end as target from (select *, max(level) over () as top from levels)),
plan as (select *, case when source_size > 0 then cast(floor(target / source_size + 1e-12) as bigint) else 0 end as whole from goals),
budget as (select *, target - whole * source_size as budget from plan),
sums as (
  select r.*, b.source_size, b.target, b.whole, b.budget,
    sum(size) over (partition by r.source order by h range between unbounded preceding and current row) as upto,
    sum(size) over (partition by r.source, h) as here
  from rows r join budget b on r.source is not distinct from b.source)
select doc_id, size, source_size, target,
  size * (whole + case when budget < 0.5 then 0 when upto <= budget then 1 when upto - here <= budget and upto - budget < budget - (upto - here) then 1 else 0 end) as taken
from sums
"""

OP7 = f"""
with d as materialized (select doc_id, {_SPACED.format(_LOWER.format('text'))} as w from documents),
s as materialized (
  select distinct doc_id, key from (
    select doc_id, array_to_string(w[k:k + 4], ' ') as key from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5)
    union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as materialized (select d.doc_id, count(key) as n from d left join s on d.doc_id = s.doc_id group by d.doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as alike from s a join s b on a.key = b.key and a.doc_id < b.doc_id group by 1, 2),
linked as materialized (select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id where 100 * alike >= 85 * (x.n + y.n - alike)),
edges as materialized (select a, b from linked union all select b, a from linked),
reach as (with recursive walk(doc_id, to_id) as (select doc_id, doc_id from d union select walk.doc_id, edges.b from walk join edges on walk.to_id = edges.a) select doc_id, min(to_id) as top from walk group by doc_id)
select n.doc_id, n.n as n_shingles, top as component_id, n.doc_id = top as kept from n join reach on n.doc_id = reach.doc_id
"""

OP10 = f"""
with d as materialized (select doc_id, {_SPACED.format("coalesce(text, '')")} as w from documents),
spans as (select doc_id, k, array_to_string(w[k:k + 19], ' ') as key from (select doc_id, w, unnest(range(1, len(w) - 18)) as k from d where len(w) >= 20)),
again as (select doc_id, k from (select doc_id, k, row_number() over (partition by key order by doc_id, k) as nth from spans) where nth > 1),
gone as materialized (select distinct doc_id, unnest(range(k, k + 20)) as at from again),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as at from d),
kept as (select w.doc_id, string_agg(word, ' ' order by w.at) as said from words w left join gone g on w.doc_id = g.doc_id and w.at = g.at where g.at is null group by w.doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(said, '')) as kept_sha256
from d left join n on d.doc_id = n.doc_id left join kept on d.doc_id = kept.doc_id
"""
