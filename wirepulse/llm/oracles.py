"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

URL_FILTER = f"""
with rules(rule, verdict, host_rule, path_rule) as (values
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'),
  ('net/fr/', 'block', 'net', '/fr/')),
rests as (select page_id, case when strpos(url, '://') > 0
  then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
urls as (select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests)
select u.page_id, u.host, u.path, arg_max(r.rule, length(r.rule)) as rule,
  coalesce(arg_max(r.verdict, length(r.rule)), 'allow') as verdict
from (select row_number() over () as row_id, * from urls) u
left join rules r on (u.host = r.host_rule or u.host like '%.' || r.host_rule)
  and starts_with(u.path, r.path_rule)
group by u.row_id, u.page_id, u.host, u.path
"""

QUALITY_RULES = f"""
with docs as (select row_number() over () as row_id, doc_id, coalesce(text, '') as t, coalesce(source, '') as host,
    {_WORDS.format("text")} as w from documents),
windows as (select row_id, i, hash(list_slice(w, i, i + 7)) as win
    from (select row_id, w, unnest(generate_series(1, len(w) - 7)) as i from docs where len(w) >= 8)),
again as (select row_id, win from windows group by row_id, win having count(*) > 1),
covered as (select w.row_id, w.i, lead(w.i) over (partition by w.row_id order by w.i) as following
    from windows w join again using (row_id, win)),
repeats as (select row_id, sum(least(8, coalesce(following - i, 8))) as n from covered group by row_id),
texts as (select host, count(distinct t) as texts from docs group by host),
lines as (select row_id, host, t, {_WORDS.format("line")} as lw
    from (select row_id, host, t, unnest(string_split(lower(t), chr(10))) as line from docs)),
common as (select l.host, l.lw from lines l join texts x on l.host = x.host where len(l.lw) > 0
    group by l.host, l.lw, x.texts
    having count(distinct l.t) > 20 and count(distinct l.t) > least(0.05 * x.texts, 1000)),
lost as (select row_id, sum(len(lw)) as lost_words from lines join common using (host, lw) group by row_id),
dup as (select row_id, count(*) - count(distinct line) as n
    from (select row_id, unnest(string_split(t, chr(10))) as line from docs)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row_id),
measured as (select d.doc_id, len(w)::bigint as n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
    coalesce(lost.lost_words, 0)::bigint as lost_words
    from docs d left join repeats r using (row_id) left join dup using (row_id) left join lost using (row_id)),
failed as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured)
select *, not base_failed and not (lost_words > 0 and (n_words - lost_words < 20
    or n_words - lost_words < 0.3 * n_words)) as kept from failed
"""

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest) as last_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> last_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last_id then last_id end as refers_to from g
"""

NGRAM_JOIN = f"""
with recursive w as (select row_number() over () as row_id, doc_id, {_WORDS.format(_LOWER.format("text"))} as w
    from documents),
shingles as (select distinct row_id, h from (
    select row_id, hash(list_slice(w, i, i + 2)) as h
    from (select row_id, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) >= 3)
    union all select row_id, hash(w) from w where len(w) between 1 and 2)),
sizes as (select row_id, count(*) as n from shingles group by row_id),
common as (select a.row_id as u, b.row_id as v, count(*) as c from shingles a join shingles b using (h)
    where a.row_id < b.row_id group by 1, 2),
links as (select u, v from common join sizes x on x.row_id = u join sizes y on y.row_id = v
    where 100 * c >= 90 * (x.n + y.n - c)),
edges as (select u, v from links union select v, u from links),
reach(u, v) as (select row_id, row_id from w union select r.u, e.v from reach r join edges e on r.v = e.u)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, min(t.doc_id) as component_id
from reach join w d on d.row_id = reach.u join w t on t.row_id = reach.v left join sizes s on s.row_id = d.row_id
group by d.row_id, d.doc_id, s.n
"""

_PLAIN = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_MASKS = ((0, 1, 2, 4, 7, 8), (0, 2, 3, 6, 8, 9), (0, 1, 4, 5, 8, 9))
_SEEDS = "[" + ", ".join(f"hash([{', '.join(f'w[i + {p}]' for p in m)}])" for m in _MASKS) + "]"
DECONTAMINATION = f"""
with d as (select doc_id, {_PLAIN} as w from documents), b as (select item_id, {_PLAIN} as w from benchmark),
dw as (select doc_id, unnest(generate_series(1, len(w) - 9)) as i, w from d where len(w) >= 10),
bw as (select item_id, unnest(generate_series(1, len(w) - 9)) as i, w from b where len(w) >= 10),
ds as (select doc_id, i, unnest({_SEEDS}) as seed, unnest([0, 1, 2]) as mask from dw),
bs as (select item_id, i, unnest({_SEEDS}) as seed, unnest([0, 1, 2]) as mask from bw),
hits as (select distinct doc_id, item_id, ds.i - bs.i as shift from ds join bs using (seed, mask)),
pairs as (select h.*, j, (j + shift between 1 and len(d.w)) and d.w[j + shift] = b.w[j] as same, len(b.w) as n
    from (select h.*, unnest(generate_series(1, len(b.w))) as j from hits h join b using (item_id)) h
    join d using (doc_id) join b using (item_id)),
sums as (select *, sum(case when same then 1 else -2 end) over o as s, sum(same::int) over o as m from pairs
    window o as (partition by doc_id, item_id, shift order by j)),
starts as (select *, min([s - (case when same then 1 else -2 end), -j, m - same::int]) over (
    partition by doc_id, item_id, shift order by j) as low from sums),
best as (select doc_id, item_id, shift, any_value(n) as n,
    max([s - low[1], -j, m - low[3]]) as best from starts group by doc_id, item_id, shift)
select doc_id, item_id, max(best[1])::int as score, max(best[3])::int as n_matched from best
group by doc_id, item_id having max(best[1]) >= least(12.0, 0.7 * any_value(n))
"""

CHAT_FORMAT = r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
marked as (select *, regexp_replace(text,
    '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g') as masked from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(masked) + length('<|im_end|>') + 1)::bigint as formatted_chars
from marked group by conv_id
"""

_TERMS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SEARCH = f"""
with d as (select row_number() over () as row_id, doc_id, {_TERMS} as terms from documents),
totals as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from d where len(terms) > 0),
tf as (select row_id, doc_id, n, term, count(*) as tf
    from (select row_id, doc_id, len(terms) as n, unnest(terms) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
items as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
weights as (select item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::double))::bigint as w
    from items join df using (term), totals),
scores as (select item_id, row_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::bigint as score
    from weights join tf using (term), totals group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank,
    doc_id, score from scores where score > 0)
select * from ranked where rank <= 50
"""

# CRC-32 byte by byte over its table; damage; then the least (cost, audit) for each number of turns and
# place in the pattern, as text: cost with leading zeros, audit. No cheapest edits insert twice between turns.
_COST = "lpad(cost::varchar, 9, '0') || audit"
TURN_REPAIR = rf"""
with recursive table_bits(i, k, c) as (select i, 0, i::bigint from range(256) r(i) union all
    select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from table_bits where k < 8),
crc_table as (select list(c order by i) as t from table_bits where k = 8),
named as (select row_number() over () as row_id, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
faults as (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(name, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as fault from named, crc_table),
damaged as (select conv_id, turn, copy, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
    from faults, (values (1), (2)) v(copy) where fault <> 0 and (copy = 1 or fault = 3)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i,
    left(role, 1) as r from damaged),
flagged as (select *, not regexp_matches(text, '[^ 	-
]') as blank,
    row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    not regexp_matches(text, '[.!?][ 	-
]*$') as unended,
    lag(r) over (partition by conv_id order by i) as r0 from numbered),
turns as (select *, blank or again as gone, unended and not blank and not again as cut from flagged),
counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (where blank)::bigint as blank, count(*) filter (where again and not blank)::bigint as duplicate,
    count(*) filter (where cut)::bigint as truncated,
    count(*) filter (where r0 || r not in ('su', 'ua', 'au'))::bigint as illegal from turns group by conv_id),
inserts(g, g2, x, ic) as (values ('0', '0', '', 0), ('s', 's', '', 0), ('u', 'u', '', 0), ('a', 'a', '', 0),
    ('0', 'u', 'I', 5), ('s', 'u', 'I', 5), ('u', 'a', 'I', 5), ('a', 'u', 'I', 5)),
moves(g, role, g2) as (values ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
edits as (select i.g, i.x || 'D' as e, ic + 2 as ec, '' as role, i.g2 as h from inserts i
    union all select i.g, i.x, ic, m.role, m.g2 from inserts i join moves m on m.g = i.g2),
states(conv_id, i, g, best) as (select conv_id, 0::bigint, '0', '000000000' from counts union all
    select conv_id, i, g, min({_COST}) from (
        select t.conv_id, t.i, e.h as g, left(s.best, 9)::bigint + e.ec
            + case when e.role = '' then 0 else (t.r <> e.role)::int + 5 * t.cut::int end as cost,
            substr(s.best, 10) || e.e || case when e.role = '' then '' when t.r = e.role then 'K' else 'R' end as audit
        from states s join turns t on t.conv_id is not distinct from s.conv_id and t.i = s.i + 1 join edits e on e.g = s.g
        where e.role = '' or (not t.gone and (e.role <> 's' or t.r = 's'))) group by conv_id, i, g),
ends as (select c.conv_id, min({_COST}) as best from (select s.conv_id, s.i, left(best, 9)::bigint + ic as cost,
        substr(best, 10) || x as audit, n.g2 from states s join inserts n on n.g = s.g where n.g2 in ('0', 'a')) f
    join counts c on c.conv_id is not distinct from f.conv_id and f.i = c.n group by c.conv_id),
letters as (select conv_id, k, substr(best, 9 + k, 1) as e from (select *, unnest(range(1, len(best) - 8)) as k from ends)),
placed as (select *, count(*) filter (where e <> 'I') over (partition by conv_id order by k) as i from letters),
stay as (select p.*, t.role, t.text, row_number() over (partition by p.conv_id order by k) - 1 as j,
    first_value(e = 'K' and t.r = 's') over (partition by p.conv_id order by k) as lead
    from placed p left join turns t on t.conv_id is not distinct from p.conv_id and t.i = p.i and p.e <> 'I' where e <> 'D'),
repaired as (select conv_id, string_agg(case when e = 'K' then role when (j - coalesce(lead, false)::int) % 2 = 0 then 'user'
    else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by k) as text from stay group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(left(best, 9)::bigint, 0) as cost, coalesce(substr(best, 10), '') as audit, sha256(coalesce(r.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
  left join ends e on e.conv_id is not distinct from o.conv_id left join repaired r on r.conv_id is not distinct from o.conv_id
"""

ORACLES = {
    "op1_url_filter": URL_FILTER,
    "op3_ngram_join": NGRAM_JOIN,
    "op5_quality_rules": QUALITY_RULES,
    "op8_warc": WARC,
    "op9_decontamination": DECONTAMINATION,
    "op11_chat_format": CHAT_FORMAT,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_turn_repair": TURN_REPAIR,
}
