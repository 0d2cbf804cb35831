"""SQL twins, in DuckDB's dialect, of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages),
g as (select *, list_transform(range(4), lambda k: ('0x' || substr(h, (10 * k + 1)::int, 10))::bigint) as v from p)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[(i // 8 + 1)::int] >> (35 - 5 * (i % 8))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to
from g"""

CONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
b as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
win as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as s from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from (select *, least(10, len(w)) as n from b where len(w) > 0))),
places as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)),
found as (select doc_id, i, n, item from places join win using (n, s)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

JACCARD = f"""
with recursive d as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i : i + 2], ' ') end as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
z as (select doc_id, count(*) as n from g group by 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from c join z za on za.doc_id = a join z zb on zb.doc_id = b where 100 * k >= 90 * (za.n + zb.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as o from d union select e.b, r.o from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, m.component_id from d left join z using (doc_id) join (select doc_id, min(o) as component_id from r group by 1) m using (doc_id)"""

REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, i, md5(substr(h, (2 * i + 1)::int, 200)) as k from (select doc_id, h, unnest(range(0, octet_length(h::blob) // 2 - 99)) as i from d)),
f as (select doc_id, i, row_number() over (partition by k order by doc_id, i) as nth from s),
p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from f where nth > 1),
t as (select doc_id, i, sum(case when before is null or i > before + 100 then 1 else 0 end) over (partition by doc_id order by i) as span from p),
r as (select doc_id, span, min(i) as a, max(i) + 100 as b from t group by 1, 2),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from r),
u as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(substr(h, (2 * since + 1)::int, (2 * (a - since))::int), '' order by a) as kept from k join d using (doc_id) group by 1)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::int))) as kept_sha256
from d left join u using (doc_id)"""


def secret_scans(rules, base: int) -> str:
    """Spans of each rule from the texts between and of its matches; the first ``base`` rules make the base digest."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"select doc_id, {n} as nth, {quote(r.kind)} as kind, regexp_extract_all(t, {quote(r.pattern)}) as found, string_split_regex(t, {quote(r.pattern)}) as gaps, {quote(r.strict or r.pattern)} as strict from d"
        for n, r in enumerate(rules)
    ]
    counts = ", ".join(f"count(*) filter (where nth = {n}) as n_{r.kind}" for n, r in enumerate(rules[:base]))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
s as (select doc_id, nth, kind, found[i] as x, strict, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0) as a from (select *, unnest(range(1, len(found) + 1)) as i from m where len(found) > 0)),
k as (select *, kind || ':' || a::bigint || ':' || (a + length(x))::bigint as span from s where regexp_full_match(x, strict)),
g as (select doc_id, {counts}, string_agg(span, ',' order by a, nth) filter (where nth < {base}) as b, string_agg(span, ',' order by a, nth) as spans from k group by 1)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in rules[:base])}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""
