"""SQL that gives the same rows, for the operators that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
windows as (
  select distinct item_id, least(13, len(w)) as width, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as words
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
),
widths as (select distinct width from windows),
places as (
  select doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') as words
  from (select doc_id, w, width, unnest(range(1, len(w) - width + 2)) as i from d, widths where len(w) >= width)
),
found as (select doc_id, i, p.width, item_id from places p join windows using (words)),
hit as (select doc_id, count(distinct i + k) as n_hit from (select distinct doc_id, i, unnest(range(0, width)) as k from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct doc_id, cast(item_id as varchar) as name from found) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

URLS = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, coalesce(rest, '') as rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as raw from u),
s as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
),
rules(rule, rule_host, rule_path, decision) as (values
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(decision, length(rule)) as decision
  from (select distinct host, path from s) join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path
),
ruled as (select page_id, s.host, s.path, rule, decision from s left join fits on s.host = fits.host and s.path = fits.path),
hosts as (
  select host, cast(count(decision) as double) as n, cast(count(*) filter (decision = 'block') as double) as blocked,
    string_split(host, '.') as l from ruled group by host
),
named as (
  select host, n, blocked, array_to_string(l[greatest(len(l) - k, 1):], '.') as domain, array_to_string(l[greatest(len(l) - k + 1, 1):], '.') as suffix
  from (select *, case when len(l) > 2 and length(l[-1]) = 2 and l[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then 2 else 1 end as k from hosts)
),
whole as (select case when sum(n) > 0 then sum(blocked) / sum(n) else 0 end as share from named),
domains as (select domain, suffix, sum(n) as n, sum(blocked) as blocked from named group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(blocked) as blocked, any_value(share) as parent from domains, whole group by suffix),
raw_s as (select suffix, case when n > 0 then blocked / n else parent end as parent from suffixes),
raw_d as (select domain, case when n > 0 then blocked / n else share end as parent from domains, whole),
moments as (
  select 's' as level, n, blocked, parent from suffixes where n > 0
  union all select 'd', n, blocked, parent from domains join raw_s using (suffix) where n > 0
  union all select 'h', n, blocked, parent from named join raw_d using (domain) where n > 0
),
sums as (
  select level, sum(n * (blocked / n - parent) * (blocked / n - parent)) as seen, sum(parent * (1 - parent)) as chance, sum(parent * (1 - parent) * (n - 1)) as room
  from moments group by level
),
strengths as (
  select level, case when room = 0 or seen <= chance then 100.0 else least(greatest(room / (seen - chance) - 1, 1.0), 100.0) end as k from sums
),
k as (
  select coalesce(max(k) filter (level = 's'), 100.0) as ks, coalesce(max(k) filter (level = 'd'), 100.0) as kd, coalesce(max(k) filter (level = 'h'), 100.0) as kh from strengths
),
post_s as (select suffix, (blocked + ks * parent) / (n + ks) as share from suffixes, k),
post_d as (select domain, (blocked + kd * p.share) / (n + kd) as share from domains join post_s p using (suffix), k),
post_h as (
  select host, blocked + kh * d.share as a, n - blocked + kh * (1 - d.share) as b from named join post_d d using (domain), k
),
verdicts as (
  select host, case when a / (a + b) - 1.645 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) >= 0.8 then 'block' else 'allow' end as by_host from post_h
)
select page_id, ruled.host, path, rule, coalesce(decision, by_host, 'allow') as verdict
from ruled left join verdicts on ruled.host = verdicts.host
"""

CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
m as (
  select *, len(regexp_extract_all(text, '[^ \t\n\r]+')) + 4 as n,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\/')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 as chars,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from t
),
p as (select *, sum(n) over (partition by conv_id order by place) - n as start from m),
w as (
  select *, 2 * (cast(start as bigint) // 640) + case when (cast(start as bigint) + n - 1) // 640 <> cast(start as bigint) // 640 then 1 else 0 end as win from p
),
f as (select conv_id, win, min(place) as first, min(start) as first_at from w group by conv_id, win),
again as (
  select f.conv_id, sum(w.chars) as chars from f join w on f.conv_id = w.conv_id and w.place < f.first
  where (w.place = 1 and w.role = 'system') or w.start >= f.first_at - 256 group by f.conv_id
),
c as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
    coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '') as counted, sum(chars) as chars
  from w group by conv_id
)
select conv_id, n_turns, turns_sha256, cast(length(counted) as bigint) as loss_chars, sha256(counted) as loss_sha256,
  cast(c.chars + coalesce(again.chars, 0) as bigint) as formatted_chars
from c left join again using (conv_id)
"""

ORACLES = {"op4_decontamination": DECONTAMINATION, "op7_urls": URLS, "op10_chat": CHAT}
