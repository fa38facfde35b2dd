"""DuckDB twins of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

TOOL_CALLS = r"""
with recursive calls as (
  select conv_id, conv_id || '-' || turn as call_id, turn as call_turn, text,
    case when turn % 4 < 2 then 'search' when turn % 8 < 6 then 'summarise' else 'translate' end as name,
    length(text) % 5 > 0 as has_limit, length(text) % 7 as "limit"
  from conversations where role = 'user'
), results as (
  select conv_id, conv_id || '-' || (turn - 1) as call_id, turn as result_turn, text as content
  from conversations where role = 'assistant'
), levels as (
  select c.conv_id, c.call_turn, 0::bigint as level from calls c
  where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.call_turn = c.call_turn - 2)
  union all
  select c.conv_id, c.call_turn, l.level + 1 from levels l join calls c on c.conv_id = l.conv_id and c.call_turn = l.call_turn + 2
), rows as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, name, level, c.call_turn, result_turn,
    case when c.call_id is null then ''
         when name = 'search' then case when has_limit then '' else 'missing:limit' end
         when name = 'summarise' then case when has_limit then 'unknown:limit' else '' end
         else 'unknown_tool' end as errors,
    case when c.call_id is null then 'null'
         when has_limit then '{"limit":' || "limit" || ',"query":' || to_json(text)::varchar || '}'
         else '{"query":' || to_json(text)::varchar || '}' end as arguments,
    c.call_id is null as orphan, content
  from calls c full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
  left join levels l on l.conv_id = c.conv_id and l.call_turn = c.call_turn
)
select conv_id, call_id, name, level, call_turn, result_turn,
  case when orphan then 'orphan' when errors <> '' then 'invalid' when result_turn is null then 'unanswered' else 'ok' end as status,
  errors,
  '{"arguments":' || arguments || ',"call_id":' || to_json(call_id)::varchar || ',"name":' || coalesce(to_json(name)::varchar, 'null')
    || ',"result":' || coalesce(to_json(content)::varchar, 'null') || '}' as record
from rows
"""

B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 of a SHA-1 from its 40 hexadecimal digits: five digits are four base32 digits.
BASE32 = "list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('" + B32 + "', 1 + ((('0x' || substr(hexed, 1 + g * 5, 5))::bigint >> s) & 31)::int, 1)), 'string_agg', '')), 'string_agg', '')"

ARC_TO_WARC = f"""
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hexed from pages
), f as (select *, min(page_id) over (partition by body) as first from p)
select page_id, strlen(body)::bigint as payload_bytes, {BASE32} as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from f
"""

EXACT_DEDUP = """
with d as (select doc_id, coalesce(text, '') as body from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(body) as text_sha256
from d window same as (partition by body)
"""

SOURCE_MIX = rf"""
with m as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from m group by source
), o as (
  select *, source_size * 2.0::double as cap, row_number() over (order by source_size * 2.0::double / weight, source nulls last) as turn,
    sum(source_size) over () * 1.5::double as budget
  from s
), l as (
  select *, (budget - coalesce(sum(cap) over (order by turn rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by turn rows between current row and unbounded following) as level
  from o
), t as (
  select source, source_size,
    least(cap, coalesce(weight * (select arg_min(level, turn) from l where level * weight <= cap), cap)) as target
  from l
), r as (
  select m.*, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as rounds
  from m join t on m.source is not distinct from t.source
), v as (
  select source, h, sum(size) as size, any_value(target - source_size * rounds) as rest, any_value(source_size) as source_size
  from r group by source, h
), c as (
  select *, coalesce(sum(size) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0) as before
  from v
), e as (select source, max(h) as edge from c where before <= rest and source_size > 0 group by source
), b as (
  select c.source, c.h + (2 * (c.rest - c.before) >= c.size)::bigint as bound
  from c join e on c.source is not distinct from e.source and c.h = e.edge
)
select r.doc_id, r.source, r.size, r.source_size, r.target,
  least(2, r.rounds + coalesce(r.h < b.bound, false)::int)::int as copies,
  (least(2, r.rounds + coalesce(r.h < b.bound, false)::int) * r.size)::bigint as taken
from r left join b on r.source is not distinct from b.source
"""

HOST_REPUTATION = r"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), n as (
  select *, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1), '') as bigint) as doc_id from u
), o as (
  select n.*, case when l.doc_id is not null then (l.quality = 1 and l.toxic = 0)::bigint end as good from n left join labels l on n.doc_id = l.doc_id
), h as (
  select host, count(good) as n, coalesce(sum(good), 0)::bigint as good,
    array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix
  from o group by host
), d as (select domain, suffix, sum(n) as n, sum(good) as good from h group by domain, suffix),
s as (select suffix, sum(n) as n, sum(good) as good from d group by suffix),
root as (select sum(n)::double as total, case when sum(n) > 0 then sum(good) / sum(n)::double else 0.5 end as rate from s),
spread as (
  select kind, n, n * (good / n::double - rate) * (good / n::double - rate) as s, 1 - n / total as one, n * (1 - n / total) as many, rate * (1 - rate) as noise
  from (select 's' as kind, n, good from s union all select 'd', n, good from d union all select 'h', n, good from h), root where n > 0
), rho as (
  select kind, case when any_value(noise) > 0 and sum(many) > sum(one)
    then least(0.99, greatest(0.0001, (sum(s) - any_value(noise) * sum(one)) / (any_value(noise) * (sum(many) - sum(one))))) else 0.0001 end as rho
  from spread group by kind
), k as (
  select 1 / coalesce(max(rho) filter (kind = 's'), 0.0001) - 1 as ks, 1 / coalesce(max(rho) filter (kind = 'd'), 0.0001) - 1 as kd,
    1 / coalesce(max(rho) filter (kind = 'h'), 0.0001) - 1 as kh from rho
), sr as (select suffix, (good + ks * rate) / (n + ks) as rate from s, k, root),
dr as (select domain, (d.good + kd * sr.rate) / (d.n + kd) as rate from d join sr using (suffix), k),
hr as (select h.host, h.n, h.good, (h.good + kh * dr.rate) / (h.n + kh) as mean, h.n + kh as weight from h join dr using (domain), k),
j as (
  select page_id, o.host, o.path, hr.n as labelled_pages, hr.good as good_pages,
    case when mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) >= 0.5 then 'allow' else 'block' end as by_method,
    case when ('.' || o.host) like '%.example.net' and starts_with(o.path, '/en/') then 'example.net/en/'
         when ('.' || o.host) like '%.example.com' and starts_with(o.path, '/de/') then 'example.com/de/'
         when ('.' || o.host) like '%.org' and starts_with(o.path, '/fr/') then 'org/fr/'
         when ('.' || o.host) like '%.net' and starts_with(o.path, '/') then 'net/' end as rule
  from o join hr on o.host = hr.host
)
select page_id, host, path, rule,
  case rule when 'example.net/en/' then 'allow' when 'example.com/de/' then 'block' when 'org/fr/' then 'allow' when 'net/' then 'block' else by_method end as verdict,
  labelled_pages, good_pages
from j
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

COLLOCATIONS = r"""
with pieces as (
  select row_number() over () as doc, coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), lists as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), spots as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from lists where len(w) > 0
), words as (
  select lang, w[i] as word, count(*) as n from spots group by all
), sizes as (
  select lang, sum(n)::bigint as n from words group by lang
), two as (
  select lang, w[i] as w1, w[i + 1] as w2, count(*) as a from spots where i < len(w) group by all having count(*) >= 10
), three as (
  select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, count(*) as a from spots where i + 1 < len(w) group by all having count(*) >= 10
), longer as (
  select lang, w1, w2, max(a) as a from (select lang, w1, w2, a from three union all select lang, w2, w3, a from three) group by all
), pairs as (
  select t.lang, t.w1 || ' ' || t.w2 as phrase, t.a, x.n as l, y.n as r, (1000000::hugeint * t.a * t.a) // (x.n::hugeint * y.n) as score
  from two t join words x on x.lang = t.lang and x.word = t.w1 join words y on y.lang = t.lang and y.word = t.w2
  left join longer g on g.lang = t.lang and g.w1 = t.w1 and g.w2 = t.w2 where g.a is null or 100 * g.a < 50 * t.a
), cuts as (
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 as phrase, t.a, x.n as l1, y.a as r1, z.a as l2, v.n as r2,
    (1000000::hugeint * t.a * t.a) // (x.n::hugeint * y.a) as s1, (1000000::hugeint * t.a * t.a) // (z.a::hugeint * v.n) as s2
  from three t join words x on x.lang = t.lang and x.word = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  join two z on z.lang = t.lang and z.w1 = t.w1 and z.w2 = t.w2 join words v on v.lang = t.lang and v.word = t.w3
), scored as (
  select * from pairs
  union all
  select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from cuts
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored
)
select r.lang, rank, phrase, a::bigint as a, l::bigint as l, r.r::bigint as r, s.n, score::bigint as score
from ranked r join sizes s on s.lang = r.lang where rank <= 2000
"""

SQL = {
    "op1_tool_calls": TOOL_CALLS,
    "op2_arc_to_warc": ARC_TO_WARC,
    "op3_exact_dedup": EXACT_DEDUP,
    "op4_source_mix": SOURCE_MIX,
    "op6_host_reputation": HOST_REPUTATION,
    "op12_collocations": COLLOCATIONS,
}
