"""SQL twins, in DuckDB's dialect, of the queries on phrases, sources and near-duplicates."""

from tabloom.llm.oracles import JACCARD

COLLOCATIONS = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
total as (select lang, sum(len(w)) as n from w group by 1),
f as (select lang, m, s, count(*) as f from (select lang, m, array_to_string(w[i : i + m - 1], ' ') as s from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest(range(1, 6)) as m) where len(w) >= m)) group by 1, 2, 3 having count(*) >= 100),
c as (select *, string_split(s, ' ') as w from f where m > 1),
inside as (select distinct lang, array_to_string(w[i : i + k - 1], ' ') as s, f from (select *, unnest(range(1, m - k + 2)) as i from (select *, unnest(range(2, m)) as k from c))),
free as (select c.* from c where not exists (select 1 from inside x where x.lang = c.lang and x.s = c.s and 100 * x.f >= 100 * c.f)),
cut as (select *, array_to_string(w[: k], ' ') as a1, array_to_string(w[k + 1 :], ' ') as a2 from (select *, unnest(range(1, m)) as k from free)),
scored as (select cut.lang, cut.s as phrase, cut.f as a, x.f as l, y.f as r, n, k, (1000::hugeint * cut.f * n) // (x.f::hugeint * y.f) as score from cut join f x on x.lang = cut.lang and x.s = a1 join f y on y.lang = cut.lang and y.s = a2 join total on total.lang = cut.lang),
least_ as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from least_ qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""

DIVERGENCE = r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') as w from documents),
t as (select lang, source, row, term, count(*) as n from (select lang, source, row, unnest(w) as term from d) group by 1, 2, 3, 4),
kept as (select lang, term, sum(n) as n from t group by 1, 2 having count(*) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, sum(n) as n from t semi join kept using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as v, sum(n) as total from kept group by 1),
z as (select g.lang, g.source, coalesce(v, 0) as v, coalesce((select sum(n) from c where c.lang = g.lang and c.source = g.source), 0) as total from g left join v using (lang)),
p as (select z.lang, z.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0)::hugeint + 5)) // (z.total::hugeint + 5 * z.v) as p from z join kept k using (lang) left join c on c.lang = z.lang and c.source = z.source and c.term = k.term),
q as (select lang, term, 1 + (1000000000::hugeint * (n::hugeint + 5)) // (total::hugeint + 5 * v) as q from kept join v using (lang)),
pair as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term where x.term is null or y.term is not null group by 1, 2, 3),
term as (select lang, source, term as item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int as r from term qualify r <= 50"""

NEAR_DUPLICATES = (
    JACCARD.replace("len(w) < 3", "len(w) < 4").replace("w[i : i + 2]", "w[i : i + 3]").replace("greatest(len(w) - 1, 2)", "greatest(len(w) - 2, 2)").replace("100 * k >= 90 *", "100 * k >= 80 *")
    .replace("m.component_id from d", "m.component_id, d.doc_id = m.component_id as kept from d")
)
