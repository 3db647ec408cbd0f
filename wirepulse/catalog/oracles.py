"""SQL that DuckDB runs on the same tables, one statement per registered query."""

from __future__ import annotations

from wirepulse.catalog import inputs
from wirepulse.dimensions import COUNTRIES, PLACES, ROOT_CODES, THEMES
from wirepulse.functions.text import ANSWER_PROMPT, LABEL_PROMPT
from wirepulse.sources.event_export import POSITIONS

ORACLES: dict[str, str] = {}
AS_OF = "(select max(date_added) from raw)"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def codes(*names: str) -> str:
    return "(" + ", ".join(quote(n) for n in names) + ")"


ROOTS = codes(*ROOT_CODES)

# --- shared table expressions -----------------------------------------------------------------

_columns = ", ".join(
    f"{e.format(ntz='timestamp')} as {n}"
    for n, e in {**inputs.EVENT_EXPRESSIONS, **inputs.LOG_EXPRESSIONS}.items()
)
RAW = f"""raw as (
  select {_columns}, p.source_url, p.page_title
  from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
               case when event_id % 43 <> 0 then event_id % (select count(*) from pages) end as pid
        from events) e
  left join (select page_id, url as source_url, {inputs.TITLE} as page_title from pages) p
    on e.pid = p.page_id)"""

RULES = """(lat is not null and lon is not null and lat between -90 and 90 and lon between -180 and 180
   and not (lat = 0 and lon = 0) and coalesce(num_mentions, 0) >= 0 and coalesce(num_sources, 0) >= 0
   and coalesce(num_articles, 0) >= 0 and coalesce(event_code, '') <> '')"""

CLEANED = f"""cleaned as (
  select * exclude (rn) from (
    select *, row_number() over (partition by global_event_id
      order by date_added desc, ingested_at desc, load_seq desc) as rn from raw)
  where rn = 1 and {RULES} and event_root_code in {ROOTS})"""


def score_sql(at: str, prefix: str = "") -> str:
    p = prefix
    return (
        f"(0.4 * least(1.0, ln(1 + greatest(coalesce({p}num_articles, 0), 0)) / ln(101)) + "
        f"0.3 * least(1.0, ln(1 + greatest(coalesce({p}num_sources, 0), 0)) / ln(26)) + "
        f"0.3 * exp(-ln(2) * greatest(0.0, epoch({at} - {p}date_added) / 3600.0) / 6.0))"
    )


SCORED = f"scored as (select *, {score_sql(AS_OF)} as intensity from cleaned)"
HISTORY = """history as (
  select * replace (date_added - to_days(cast(load_seq % 6 * 30 as int)) as date_added) from raw)"""
VALID_HISTORY = f"valid_history as (select * from history where {RULES})"

LINES = f"""lines as (
  select cycle, load_seq as line_no, {inputs.line_expression('chr(9)')} as value from raw)"""


def _int(i: int, kind: str) -> str:
    t = f"trim(f[{i + 1}])"
    return f"case when regexp_full_match({t}, '[+-]?[0-9]+') then try_cast({t} as {kind}) end"


def _double(i: int) -> str:
    t = f"trim(f[{i + 1}])"
    return f"case when regexp_full_match({t}, '[+-]?[0-9]+([.][0-9]*)?') then try_cast({t} as double) end"


def _text(i: int) -> str:
    return f"nullif(trim(f[{i + 1}]), '')"


_kinds = {
    "global_event_id": lambda i: _int(i, "bigint"),
    "event_date": lambda i: f"try_strptime(f[{i + 1}], '%Y%m%d')",
    "date_added": lambda i: f"try_strptime(f[{i + 1}], '%Y%m%d%H%M%S')",
    "event_code": lambda i: f"trim(f[{i + 1}])",
    "event_root_code": lambda i: f"trim(f[{i + 1}])",
    **{c: (lambda i: _int(i, "int")) for c in ("quad_class", "num_mentions", "num_sources", "num_articles")},
    **{c: _double for c in ("avg_tone", "lat", "lon")},
}
_fields = ", ".join(f"{_kinds.get(c, _text)(i)} as {c}" for c, i in POSITIONS.items())
_bad_number = " or ".join(
    f"(trim(f[{POSITIONS[c] + 1}]) <> '' and {c} is null)"
    for c in ("quad_class", "num_mentions", "num_sources", "num_articles", "avg_tone", "lat", "lon")
)
PARSED = f"""{LINES},
typed as (
  select cycle, line_no, f, {_fields}
  from (select cycle, line_no, string_split(value, chr(9)) as f from lines where trim(value) <> '')),
classified as (
  select * exclude (f), case when len(f) <> 61 then 'bad_column_count'
    when global_event_id is null then 'bad_event_id'
    when event_date is null or date_added is null then 'bad_timestamp'
    when {_bad_number} then 'bad_numeric_field' end as reason from typed),
good as (select * exclude (reason) from classified where reason is null)"""

RULE_REASON = """case when not coalesce(lat between -90 and 90 and lon between -180 and 180
      and not (lat = 0 and lon = 0), false) then 'invalid_coordinates'
    when coalesce(num_mentions, 0) < 0 or coalesce(num_sources, 0) < 0 or coalesce(num_articles, 0) < 0
      then 'negative_counts'
    when coalesce(event_code, '') = '' then 'missing_event_code' end"""
VALID = f"""judged as (select *, {RULE_REASON} as rule from good),
ranked as (
  select *, row_number() over (partition by cycle, global_event_id order by line_no desc) as rn
  from judged where rule is null),
valid as (select * exclude (rule, rn) from ranked where rn = 1),
drops as (select cycle, rule as reason from judged where rule is not null
  union all select cycle, 'duplicate_event_id_in_batch' from ranked where rn > 1)"""

# The entities of the table; a title cut off before the semicolon still counts.
_entities = (
    "regexp_replace(regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&copy;?', '©', 'g'), "
    "'&amp;?', '&', 'g')"
)
_page_title = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
TITLES = f"""titles as (
  select url, arg_max(title, n) as page_title from (
    select url, n, trim({_entities.format('t')}) as title from (
      select url, {_page_title} as t, page_id as n from pages where {_page_title} <> ''
      union all
      select url, {_page_title} || ' (updated)', 1000000000 + page_id from pages where page_id % 7 = 0))
  where title <> '' group by url)"""
RUNS = """loaded as (
  select v.*, t.page_title from valid v left join titles t on v.source_url = t.url),
parse_drops as (
  select cycle, string_agg(reason || '=' || n, ',' order by reason) as d from (
    select cycle, reason, count(*) as n from classified where reason is not null group by all) group by cycle),
validation_drops as (
  select cycle, string_agg(reason || '=' || n, ',' order by reason) as d from (
    select cycle, reason, count(*) as n from drops group by all) group by cycle),
runs as (
  select c.cycle, c.rows_fetched, c.rows_parsed,
    c.rows_fetched - coalesce(l.rows_loaded, 0) as rows_rejected,
    coalesce(l.rows_loaded, 0) as rows_loaded, coalesce(l.titles_matched, 0) as titles_matched,
    coalesce(p.d, '') as parse_drops, coalesce(v.d, '') as validation_drops,
    cast(c.cycle as timestamp) as run_at
  from (select cycle, count(*) as rows_fetched, count(*) filter (where reason is null) as rows_parsed
        from classified group by cycle) c
  left join (select cycle, count(*) as rows_loaded, count(page_title) as titles_matched
             from loaded group by cycle) l using (cycle)
  left join parse_drops p using (cycle) left join validation_drops v using (cycle))"""

EMBED = """list_transform(range(64), lambda b: len(list_filter(list_transform(
    list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''),
    lambda w: cast('0x' || right(md5(w), 2) as int) % 64), lambda x: x = b)))"""


def unit_vector(counts: str) -> str:
    dbl = f"cast({counts} as double[])"
    return f"list_transform({dbl}, lambda z: z / sqrt(list_dot_product({dbl}, {dbl})))"


COMPONENTS = f"""nodes as (
  select page_title, min(global_event_id) as id from scored where page_title is not null group by page_title),
counts as (select id, page_title, {EMBED.format('page_title')} as c from nodes),
vectors as (select id, page_title, {unit_vector('c')} as v from counts),
edges as (
  select a.id as src, b.id as dst from vectors a, vectors b
  where a.id <> b.id and round(list_dot_product(a.v, b.v), 9) >= 0.6),
reach as (
  select id as node, id as other from nodes
  union select r.node, e.dst from reach r join edges e on r.other = e.src),
labels as (select node, min(other) as story_id from reach group by node),
members as (
  select s.*, l.story_id from scored s join nodes n using (page_title) join labels l on l.node = n.id)"""


# The two newest runs of the story job, each over the titled events of the day before it.
RUN_STORIES = f"""run_times as (select {AS_OF} - to_hours(h) as run_at from (values (24), (0)) r(h)),
run_events as (select s.*, run_at from scored s join run_times on page_title is not null
  and date_added <= run_at and date_added >= run_at - interval 24 hour),
run_nodes as (select run_at, page_title, min(global_event_id) as id from run_events group by all),
run_vectors as (select run_at, id, {unit_vector('c')} as v from (
  select run_at, id, c from run_nodes join (
    select page_title, {EMBED.format('page_title')} as c from (select distinct page_title from run_events)) using (page_title))),
run_edges as (select a.run_at, a.id as src, b.id as dst from run_vectors a join run_vectors b using (run_at)
  where a.id <> b.id and round(list_dot_product(a.v, b.v), 9) >= 0.6),
run_reach as (select run_at, id as node, id as other from run_nodes
  union select r.run_at, r.node, e.dst from run_reach r join run_edges e on r.run_at = e.run_at and r.other = e.src),
run_labels as (select run_at, node, min(other) as story_id from run_reach group by all),
run_members as (select e.*, l.story_id from run_events e join run_nodes n using (run_at, page_title)
  join run_labels l on l.run_at = e.run_at and l.node = n.id)"""


def stories_sql(members: str, keys: str, run_at: str) -> str:
    return f"""
  select {keys}, rep.page_title as rep_title, rep.source_url as rep_url, rep.lat as lat, rep.lon as lon,
    member_count, total_articles, total_sources, intensity, avg_tone,
    case when articles_last_hour > articles_prev_hour * 1.2 then 'rising'
         when articles_last_hour < articles_prev_hour * 0.8 then 'falling' else 'steady' end as trend,
    articles_last_hour, articles_prev_hour, coalesce(urls, []) as source_urls,
    rep.action_geo_full_name as location, rep.action_geo_country_code as country_code, earliest, latest
  from (
    select {keys},
      arg_max({{'page_title': page_title, 'source_url': source_url, 'lat': lat, 'lon': lon,
        'action_geo_full_name': action_geo_full_name, 'action_geo_country_code': action_geo_country_code}},
        {{'a': coalesce(num_articles, 0), 'i': intensity, 'n': -global_event_id}}) as rep,
      count(*) as member_count, cast(sum(coalesce(num_articles, 0)) as bigint) as total_articles,
      cast(sum(coalesce(num_sources, 0)) as bigint) as total_sources, max(intensity) as intensity,
      avg(avg_tone) as avg_tone, min(date_added) as earliest, max(date_added) as latest,
      cast(sum(case when date_added >= {run_at} - interval 1 hour then coalesce(num_articles, 0) else 0 end) as bigint)
        as articles_last_hour,
      cast(sum(case when date_added >= {run_at} - interval 2 hour and date_added < {run_at} - interval 1 hour
        then coalesce(num_articles, 0) else 0 end) as bigint) as articles_prev_hour
    from {members} group by {keys})
  left join (
    select {keys}, list(source_url order by f)[1:5] as urls from (
      select {keys}, source_url, min(global_event_id) as f from {members}
      where source_url <> '' group by {keys}, source_url) group by {keys}) using ({keys})"""


STORIES = f"stories as ({stories_sql('members', 'story_id', AS_OF)})"
STORED_STORIES = f"stored_stories as ({stories_sql('run_members', 'run_at, story_id', 'run_at')})"
LABELLED = """usable as (
  select story_id, label from (
    select story_id, member_count, nullif(rtrim(trim(string_split(
      trim(trim(trim(' "' || rep_title || '."' || chr(10) || 'more'), '"'), ''''), chr(10))[1]), '.'), '') as label
    from stories where member_count >= 2 and story_id % 3 <> 0)
  where label is not null order by member_count desc, story_id limit 25),
labelled as (
  select s.*, u.label, coalesce(u.label, s.rep_title) as summary from stories s left join usable u using (story_id))"""
STORY_TEXT = """rep_title, rep_url, lat, lon, member_count, total_articles, total_sources,
  round(intensity, 6) as intensity, round(avg_tone, 6) as avg_tone, trend, articles_last_hour,
  articles_prev_hour, array_to_string(source_urls, '|') as source_urls, location, country_code,
  cast(earliest as varchar) as earliest, cast(latest as varchar) as latest"""

EVENT_TEXT = """global_event_id, cast(event_date as varchar) as event_date, cast(date_added as varchar) as date_added,
  actor1_name, actor2_name, event_code, event_root_code, quad_class, num_mentions, num_sources, num_articles,
  round(avg_tone, 6) as avg_tone, action_geo_full_name, action_geo_country_code, round(lat, 6) as lat,
  round(lon, 6) as lon, source_url"""
HIT_TEXT = """global_event_id, cast(date_added as varchar) as date_added, event_root_code, lat, lon,
  round(intensity, 6) as intensity"""
ROLLUP_TEXT = """cast(day as varchar) as day, cell_lat, cell_lon, event_root_code, round(rep_lat, 6) as rep_lat,
  round(rep_lon, 6) as rep_lon, event_count, total_articles, total_sources, round(avg_tone, 6) as avg_tone"""


def rollup_sql(source: str, condition: str = "true") -> str:
    return f"""select cast(date_added as date) as day, cast(floor(lat / 2) as int) as cell_lat,
    cast(floor(lon / 2) as int) as cell_lon, event_root_code, avg(lat) as rep_lat, avg(lon) as rep_lon,
    count(*) as event_count, cast(sum(num_articles) as bigint) as total_articles,
    cast(sum(num_sources) as bigint) as total_sources, avg(avg_tone) as avg_tone
  from {source} where {condition} group by all"""


def add(name: str, *parts: str, select: str, recursive: bool = False) -> None:
    head = "with recursive " if recursive else "with "
    ORACLES[name] = head + ",\n".join(parts) + "\n" + select


# --- parsing and validation -------------------------------------------------------------------

add("zip_lines", RAW, LINES, select="""
select cycle, count(*) as lines, cast(sum(length(value)) as bigint) as chars, min(md5(value)) as first_digest,
  max(md5(value)) as last_digest from lines group by cycle""")
add("parse_events", RAW, PARSED, select=f"select cycle, line_no, {EVENT_TEXT} from good")
add("parse_rejects", RAW, PARSED, select="""
select cycle, line_no, reason from classified where reason is not null""")
add("parse_reject_counts", RAW, PARSED, select="""
select reason, count(*) as rows from classified where reason is not null group by reason""")
add("gkg_titles", TITLES, select="select url, page_title from titles")
add("validate_events", RAW, PARSED, VALID, select=f"select cycle, line_no, {EVENT_TEXT} from valid")
add("validation_drop_counts", RAW, PARSED, VALID, select="""
select reason, count(*) as rows from drops group by reason""")
add("title_join", RAW, PARSED, VALID, TITLES, select="""
select v.cycle, v.line_no, v.global_event_id, v.source_url, t.page_title
from valid v left join titles t on v.source_url = t.url""")
add("run_metrics", RAW, PARSED, VALID, TITLES, RUNS, select="select * exclude (run_at) from runs")
add("recent_runs", RAW, PARSED, VALID, TITLES, RUNS, select="""
select cast(run_at as varchar) as run_at, rows_fetched, rows_parsed, rows_rejected, rows_loaded, titles_matched
from runs order by runs.run_at desc limit 20""")
add("cycle_counts", RAW, select="""
select strftime(time_bucket(interval 15 minute, date_added), '%Y%m%d%H%M%S') as cycle, count(*) as rows
from raw group by 1""")
add("missing_cycles", RAW, select="""
select strftime(s, '%Y%m%d%H%M%S') as cycle from (
  select unnest(generate_series(time_bucket(interval 15 minute, min(date_added)),
    time_bucket(interval 15 minute, max(date_added)), interval 15 minute)) as s from raw)
where s not in (select time_bucket(interval 15 minute, date_added) from raw)""")
add("jsonl_roundtrip", RAW, PARSED, VALID, select=f"select {EVENT_TEXT} from valid")

# --- landing table ----------------------------------------------------------------------------

add("upsert_merge", RAW, """upsert_log as (
  select * from raw
  union all
  select * replace (num_articles + 5 as num_articles, num_mentions * 2 as num_mentions, 'LATER' as actor1_name,
    case when num_mentions % 2 = 0 then page_title end as page_title, load_seq + 1000000000 as load_seq)
  from raw where quad_class = 2)""", select=f"""
select load_seq, strftime(f.date_added, '%Y-%m') as month, {EVENT_TEXT}, page_title from (
  select f.* replace (l.num_mentions as num_mentions, l.num_sources as num_sources,
    l.num_articles as num_articles, l.avg_tone as avg_tone, l.page_title as page_title, l.load_seq as load_seq)
  from (select *, row_number() over (partition by global_event_id, date_added order by load_seq) as rn
        from upsert_log) f
  join (select *, row_number() over (partition by global_event_id, date_added order by load_seq desc) as rn
        from upsert_log) l
  on f.global_event_id = l.global_event_id and f.date_added = l.date_added and f.rn = 1 and l.rn = 1) f""")
PARTITIONS = """partitions as (
  select 'raw_events_y' || strftime(lower, '%Y') || 'm' || strftime(lower, '%m') as name, lower,
    lower + interval 1 month as upper, rows
  from (select date_trunc('month', date_added)::timestamp as lower, count(*) as rows from history group by 1))"""
add("landing_bounds", RAW, HISTORY, select="""
select cast(min(date_added) as varchar) as lo, cast(max(date_added) as varchar) as hi from history""")
add("landing_compacted", RAW, HISTORY, """log as (
  select *, 0 as load from history union all
  select * replace (num_articles + 5 as num_articles, 'LATER' as actor1_name, null as avg_tone), 1 from history
  where quad_class = 2 and date_added >= timestamp '2023-12-01 00:00:00'),
current as (
  select first.* replace (last.num_mentions as num_mentions, last.num_sources as num_sources,
    last.num_articles as num_articles, last.avg_tone as avg_tone, last.page_title as page_title)
  from (select * from log qualify row_number() over (partition by global_event_id, date_added order by load) = 1) first
  join (select * from log qualify row_number() over (partition by global_event_id, date_added order by load desc) = 1) last
    using (global_event_id, date_added))""", select=f"""
select {EVENT_TEXT}, page_title, strftime(c.date_added, '%Y-%m') as month from (
  select * exclude (source_url, page_title), null::varchar as source_url, null::varchar as page_title from current) c""")
add("scored_layer", RAW, HISTORY, """log as (
  select *, 0 as load, timestamp '2024-02-01' as taken from history union all
  select * replace (num_articles + 5 as num_articles,
    date_added + to_days(cast(case when load_seq % 2 = 0 then 31 else 0 end as int)) as date_added), 1, timestamp '2024-02-02'
  from history where quad_class = 2 and date_added >= timestamp '2023-12-01 00:00:00'),
current as (
  select first.* replace (last.num_mentions as num_mentions, last.num_sources as num_sources,
    last.num_articles as num_articles, last.load as load)
  from (select * from log qualify row_number() over (partition by global_event_id, date_added order by load, cycle) = 1) first
  join (select * from log qualify row_number() over (partition by global_event_id, date_added order by load desc, cycle desc) = 1) last
    using (global_event_id, date_added)),
newest as (
  select * from current qualify row_number() over (partition by global_event_id
    order by date_added desc, taken desc, load desc) = 1)""", select=f"""
select global_event_id, strftime(date_added, '%Y-%m') as month, cast(date_added as varchar) as date_added, num_articles,
  num_sources, cast(load as bigint) as load_seq, round({score_sql("timestamp '2024-02-01 00:00:00'")}, 6) as intensity
from newest where {RULES} and event_root_code in {ROOTS}""")
add("partition_counts", RAW, HISTORY, PARTITIONS, select="""
select name, cast(lower as varchar) as lower, cast(upper as varchar) as upper, rows from partitions""")
add("repartition_monthly", RAW, HISTORY, select="""
select strftime(date_added, '%Y-%m') as month, count(*) as rows, min(global_event_id) as min_id,
  max(global_event_id) as max_id, cast(sum(num_mentions) as bigint) as mentions
from (select *, row_number() over (partition by global_event_id, date_added order by load_seq) as rn from history)
where rn = 1 group by 1""")
add("daily_rollup", RAW, HISTORY, VALID_HISTORY, select=f"""
select {ROLLUP_TEXT} from ({rollup_sql('valid_history')})""")
add("rollup_insert_absent", RAW, HISTORY, VALID_HISTORY, select=f"""
select {ROLLUP_TEXT} from ({rollup_sql('valid_history')}) n
where not exists (select 1 from valid_history h where h.date_added < timestamp '2023-11-01 00:00:00'
  and cast(h.date_added as date) = n.day and cast(floor(h.lat / 2) as int) = n.cell_lat
  and cast(floor(h.lon / 2) as int) = n.cell_lon and h.event_root_code = n.event_root_code)""")
CUTOFF = "(timestamp '2024-03-01 00:00:00' - interval 90 day)"
EXPIRED = f"date_trunc('month', date_added) + interval 1 month <= {CUTOFF}"
add("expired_partitions", RAW, HISTORY, PARTITIONS, select=f"""
select name, cast(lower as varchar) as lower, cast(upper as varchar) as upper, rows
from partitions where partitions.upper <= {CUTOFF}""")
add("retention_rollup", RAW, HISTORY, VALID_HISTORY, select=f"""
select {ROLLUP_TEXT} from ({rollup_sql('valid_history', EXPIRED)})""")
add("retained_raw", RAW, HISTORY, VALID_HISTORY, select=f"""
select load_seq, global_event_id, cast(date_added as varchar) as date_added, event_root_code
from valid_history where not ({EXPIRED.replace('date_added', 'valid_history.date_added')})""")

add("retention_run", RAW, HISTORY, VALID_HISTORY, select=f"""
select 'raw' as layer, strftime(h.date_added, '%Y-%m') as month, cast(h.quad_class % 2 as bigint) as load,
  count(*) as rows, count(*) as events, cast(sum(h.num_articles) as bigint) as articles
from valid_history h where not ({EXPIRED.replace('date_added', 'h.date_added')}) group by 1, 2, 3
union all
select 'rollup', strftime(day, '%Y-%m'), null, count(*), cast(sum(event_count) as bigint), cast(sum(total_articles) as bigint)
from ({rollup_sql('valid_history', EXPIRED)}) group by 2""")

# --- cleaned and scored layers, event queries -------------------------------------------------

add("clean_events", RAW, CLEANED, select=f"select {EVENT_TEXT}, page_title from cleaned")
add("score_events", RAW, CLEANED, SCORED, select=f"""
select global_event_id, cast(date_added as varchar) as date_added, num_articles, num_sources,
  round(intensity, 6) as intensity, cast({AS_OF} as varchar) as scored_at from scored""")
add("events_bbox", RAW, CLEANED, SCORED, select=f"""
select {HIT_TEXT} from scored where lon between -10.5 and 30 and lat between 35 and 60""")
add("events_time_window", RAW, CLEANED, SCORED, select=f"""
select {HIT_TEXT} from scored where scored.date_added >= timestamp '2024-01-10 06:00:00'
  and scored.date_added <= timestamp '2024-01-12 18:30:00'""")
add("events_category", RAW, CLEANED, SCORED, select=f"""
select {HIT_TEXT} from scored where event_root_code in ('04', '14')""")
add("events_theme", RAW, CLEANED, SCORED, select=f"""
select {HIT_TEXT} from scored where event_root_code in ('04', '14', '18', '19', '20')""")
RANKED_TEXT = """global_event_id, cast(date_added as varchar) as date_added, event_root_code, page_title, lat, lon,
  round(effective, 6) as effective_intensity"""
TOP = "top as (select *, intensity as effective from scored order by effective desc, global_event_id limit 500)"
add("events_topk", RAW, CLEANED, SCORED, TOP, select=f"select {RANKED_TEXT} from top")
_at = "timestamp '2024-01-15 12:00:00'"
add("events_at", RAW, CLEANED, SCORED, f"""top as (
  select *, {score_sql(_at)} as effective from scored
  where lon between -120 and 120 and lat between -50 and 70 and date_added <= {_at}
    and event_root_code in ('01', '02', '03', '04', '05', '13', '15', '16', '17')
  order by effective desc, global_event_id limit 500)""", select=f"select {RANKED_TEXT} from top")
ISO = "replace(cast({} as varchar), ' ', 'T') || '+00:00'"
add("events_geojson", RAW, CLEANED, SCORED, TOP, select=f"""
select global_event_id as id, cast(json_object('type', 'Feature',
  'geometry', json_object('type', 'Point', 'coordinates', json_array(lon, lat)),
  'properties', json_object('id', global_event_id, 'title', page_title, 'intensity', round(effective, 6),
    'num_articles', num_articles, 'num_sources', num_sources, 'num_mentions', num_mentions,
    'avg_tone', avg_tone, 'event_code', event_code, 'event_root_code', event_root_code,
    'quad_class', quad_class, 'date_added', {ISO.format('date_added')}, 'location', action_geo_full_name,
    'country_code', action_geo_country_code, 'source_url', source_url, 'actor1', actor1_name,
    'actor2', actor2_name)) as varchar) as feature from top""")
add("geojson_flatten", RAW, CLEANED, SCORED, TOP, select=f"""
select lon as lng, lat, global_event_id as id, page_title as title, round(effective, 6) as intensity, num_articles,
  num_sources, num_mentions, avg_tone, event_code, event_root_code, quad_class,
  {ISO.format('date_added')} as date_added, action_geo_full_name as location,
  action_geo_country_code as country_code, source_url, actor1_name as actor1, actor2_name as actor2 from top""")
add("display_label", RAW, CLEANED, SCORED, select="""
select global_event_id, coalesce(nullif(page_title, ''),
  nullif(concat_ws(' – ', nullif(actor1_name, ''), nullif(actor2_name, '')), ''),
  'Event ' || global_event_id) as label, cast(floor(round(intensity, 9) * 100 + 0.5) as int) as buzz from scored""")
add("markers_at_altitude", RAW, CLEANED, SCORED, """cells as (
  select altitude, arg_max({'id': global_event_id, 'lat': lat, 'lon': lon, 'intensity': intensity},
      {'i': intensity, 'n': -global_event_id}) as rep,
    cast(case when count(*) > 1 then sum(coalesce(num_articles, 0)) else sum(num_articles) end as bigint) as num_articles,
    cast(case when count(*) > 1 then sum(coalesce(num_sources, 0)) else sum(num_sources) end as bigint) as num_sources,
    case when count(*) > 1 then count(*) end as cluster_size
  from scored, (values (2.5::double, 8), (1.5::double, 4), (0.9::double, 2)) l(altitude, c)
  group by altitude, floor(lat / c), floor(lon / c))""", select="""
select altitude, rep.id as id, rep.lat as lat, rep.lon as lon, round(rep.intensity, 6) as intensity, num_articles,
  num_sources, cluster_size from cells
union all select 0.5::double, global_event_id, lat, lon, round(intensity, 6), num_articles::bigint, num_sources::bigint,
  null::bigint from scored""")
add("zoom_grid", RAW, CLEANED, SCORED, select="""
select c as cell_deg, cast(floor(lat_ / c) as int) as cell_lat, cast(floor(lon_ / c) as int) as cell_lon,
  rep.id as id, rep.lat as lat, rep.lon as lon, round(rep.intensity, 6) as intensity,
  num_articles, num_sources, cluster_size from (
  select c, floor(lat / c) * c as lat_, floor(lon / c) * c as lon_,
    arg_max({'id': global_event_id, 'lat': lat, 'lon': lon, 'intensity': intensity},
            {'i': intensity, 'n': -global_event_id}) as rep,
    cast(case when count(*) > 1 then sum(coalesce(num_articles, 0)) else sum(num_articles) end as bigint) as num_articles,
    cast(case when count(*) > 1 then sum(coalesce(num_sources, 0)) else sum(num_sources) end as bigint) as num_sources,
    case when count(*) > 1 then count(*) end as cluster_size
  from scored, (values (8), (4), (2)) l(c) group by 1, 2, 3)""")
add("slider_replay", RAW, CLEANED, SCORED, f"""bounds as (
  select time_bucket(interval 15 minute, {AS_OF}) as hi),
ticks as (select unnest(generate_series(hi - interval 48 hour, hi, interval 15 minute)) as tick from bounds)""",
    select=f"""
select cast(tick as varchar) as tick, cast(rank as int) as rank, global_event_id, round(effective, 6) as effective_intensity from (
  select *, row_number() over (partition by tick order by round(effective, 9) desc, global_event_id) as rank from (
    select tick, global_event_id, {score_sql('tick', 's.')} as effective
    from scored s join ticks t on s.date_added between t.tick - interval 6 hour and t.tick))
where rank <= 1000""")
add("slider_counts", RAW, CLEANED, SCORED, """ticks as (
  select unnest(generate_series(time_bucket(interval 15 minute, min(date_added)),
    time_bucket(interval 15 minute, max(date_added)) + interval 390 minute, interval 15 minute)) as tick from scored)""",
    select="""
select cast(t.tick as varchar) as tick, count(*) as events, cast(sum(coalesce(num_articles, 0)) as bigint) as articles
from scored s join ticks t on s.date_added between t.tick - interval 6 hour and t.tick group by t.tick""")
_places = ", ".join(
    f"({i}, {quote(kind)}, {quote(name)}, {lat}, {lon}, {alt})"
    for i, (kind, name, lat, lon, alt) in enumerate(PLACES)
)

def _place_search(terms: str) -> tuple[str, str]:
    """Table expressions of a search for ``terms`` and the query."""
    return f"""terms as ({terms}),
places(n, kind, name, lat, lon, altitude) as (values {_places}),
spots as (
  select action_geo_full_name as name, arg_min({{'lat': lat, 'lon': lon}},
    {{'i': -round(intensity, 9), 'n': global_event_id}}) as at_,
    min({{'i': -round(intensity, 9), 'n': global_event_id}}) as first_ from scored group by 1),
found as (
  select term, kind, name, cast(lat as double) as lat, cast(lon as double) as lon, cast(altitude as double) as altitude,
    case kind when 'region' then 1 else 2 end as grp, 0 as ord from terms, places where contains(lower(name), term)
  union all
  select term, 'place', name, at_.lat, at_.lon, 0.9, 3, ord from (
    select *, row_number() over (partition by term order by first_) as ord
    from terms, spots where contains(lower(name), term)) where ord <= 4)""", """
select term, position, kind, name, lat, lon, altitude from (
  select *, cast(row_number() over (partition by term order by grp, ord, name) as int) as position from found)
where position <= 8"""


_expressions, _select = _place_search("select unnest(['united', 'in', 'france', 'region 3', 'east']) as term")
add("place_search", RAW, CLEANED, SCORED, _expressions, select=_select)
_expressions, _select = _place_search("""
  with words as (select distinct unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) as w from (
    select page_title as t from titled union select action_geo_full_name from scored))
  select distinct term from (select w as term from words union select left(w, 3) from words) where length(term) >= 2""")
add("place_search_many", RAW, CLEANED, SCORED, f"""titled as (
  select {inputs.TITLE} as page_title from pages)""", _expressions, select=_select)


def _check(table: str, source: str, column: str, kind: str, accepted: str = "") -> str:
    failures = {
        "not_null": f"(select count(*) from {source} where {column} is null)",
        "unique": f"(select count(*) from (select {column} from {source} where {column} is not null "
        f"group by {column} having count(*) > 1))",
        "accepted_values": f"(select count(distinct {column}) from {source} where {column} not in ({accepted}))",
    }[kind]
    column = "geom" if column == "lat + lon" else column
    return f"""select {quote(table)} as "table", {quote(column)} as "column", {quote(kind)} as "check", {failures} as failures"""


_checks = [
    ("raw_events", "raw", "global_event_id", "unique"), ("raw_events", "raw", "global_event_id", "not_null"),
    ("raw_events", "raw", "date_added", "not_null"),
    ("stg_events", "raw", "global_event_id", "unique"), ("stg_events", "raw", "global_event_id", "not_null"),
    ("cleaned_events", "cleaned", "global_event_id", "unique"),
    *[("cleaned_events", "cleaned", c, "not_null")
      for c in ("global_event_id", "lat", "lon", "event_code", "event_root_code")],
    ("cleaned_events", "cleaned", "event_root_code", "accepted_values", ROOTS[1:-1]),
    ("cleaned_events", "cleaned", "quad_class", "accepted_values", "1, 2, 3, 4"),
    ("events_scored", "scored", "global_event_id", "unique"),
    *[("events_scored", "scored", c, "not_null")
      for c in ("global_event_id", "intensity", "lat + lon", "date_added")],
]
add("dq_report", RAW, CLEANED, SCORED, select=" union all ".join(_check(*c) for c in _checks))
add("dq_intensity_range", RAW, CLEANED, SCORED, select="""
select global_event_id, intensity from scored where intensity < 0 or intensity > 1""")

# --- map requests -----------------------------------------------------------------------------

_request_columns = ", ".join(f"{e} as {n}" for n, e in inputs.REQUEST_EXPRESSIONS.items())
_side = "try_cast(trim(string_split(bbox, ',')[{}]) as double)"
_theme_codes = " ".join(
    f"when {quote(k)} then [{', '.join(quote(c) for c in cs)}]" for k, (_, cs) in THEMES.items()
)
REQUESTS = f"""requests as (
  select request_id, bbox, category, theme, lim, len(string_split(bbox, ',')) as parts,
    {_side.format(1)} as west, {_side.format(2)} as south, {_side.format(3)} as east, {_side.format(4)} as north,
    timestamp '2024-01-01' + to_days(start_day) as start_, timestamp '2024-01-01' + to_days(end_day) as end_,
    timestamp '2024-01-01' + to_days(at_day) as at_
  from (select {_request_columns} from supplier)),
judged_requests as (
  select *, case when lim not between 1 and 5000 then 'limit_out_of_range'
    when bbox is not null and parts <> 4 then 'bbox_needs_four_numbers'
    when bbox is not null and (west is null or south is null or east is null or north is null) then 'bbox_not_numeric'
    when not (west between -180 and 180 and east between -180 and 180) then 'longitude_out_of_range'
    when not (south between -90 and 90 and north between -90 and 90) then 'latitude_out_of_range'
    when south > north then 'south_above_north' when start_ > end_ then 'start_after_end'
    when category not in {ROOTS} then 'unknown_root_code'
    when theme not in {codes(*THEMES)} then 'unknown_theme' end as reason from requests)"""
add("request_validate", REQUESTS, select="select request_id, reason from judged_requests")
add("request_dedupe", REQUESTS, select="""
select min(request_id) as request_id, count(*) as copies from (
  select * from requests union all select * replace (request_id + 1000000 as request_id) from requests)
group by bbox, end_, at_, category, theme, lim""")
add("batch_viewport", RAW, CLEANED, SCORED, REQUESTS, f"""accepted as (
  select request_id, lim, start_, end_, at_, coalesce(west, -180) as west, coalesce(south, -90) as south,
    coalesce(east, 180) as east, coalesce(north, 90) as north,
    list_concat(case when category is null then [] else [category] end,
      case theme {_theme_codes} else [] end) as wanted
  from judged_requests where reason is null)""", select=f"""
select request_id, cast(rank as int) as rank, global_event_id, round(effective, 6) as effective_intensity from (
  select *, row_number() over (partition by request_id order by round(effective, 9) desc, global_event_id) as rank
  from (
    select request_id, lim, global_event_id,
      case when at_ is null then intensity else {score_sql('at_', 's.')} end as effective
    from accepted a join scored s on s.lon between least(west, east) and greatest(west, east)
      and s.lat between south and north and (start_ is null or s.date_added >= start_)
      and (end_ is null or s.date_added <= end_) and (len(wanted) = 0 or list_contains(wanted, event_root_code))))
where rank <= lim""")
add("rate_limit_audit", """busy as (
  select user_id, date_trunc('day', ts)::timestamp as window_start, count(*) as requests
  from events group by 1, 2 having count(*) > 3)""", select="""
select user_id, cast(window_start as varchar) as window_start, requests, requests - 3 as rejected from busy""")
ORACLES["stream_user_rate"] = ORACLES["rate_limit_audit"]
add("rate_limit_rejects", """numbered as (
  select *, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as rn
  from events)""", select="""
select event_id as request_id, user_id,
  86400 - cast(floor(epoch(ts) - epoch(date_trunc('day', ts)::timestamp)) as bigint) as retry_after
from numbered where rn > 3""")

# --- stories ----------------------------------------------------------------------------------

add("embed_titles", f"""titled as (select page_id, {inputs.TITLE} as t from pages)""", select=f"""
select page_id, array_to_string({EMBED.format('t')}, ',') as buckets from titled where t is not null""")
add("similar_pairs", """v as (select vec_id as id, cast(embedding as double[]) as e from embeddings),
pairs as (
  select a.id, b.id as other, round(list_dot_product(a.e, b.e), 9) as sim from v a join v b on a.id <> b.id)""",
    select="""
select id, count(*) as partners, -max({'s': sim, 'n': -other}).n as best_id, max(sim) as best_similarity
from pairs where sim >= 0.4 group by id""")
add("story_input", RAW, CLEANED, SCORED, select=f"""
select global_event_id, cast(date_added as varchar) as date_added, page_title from scored
where scored.date_added >= {AS_OF} - interval 6 hour and page_title is not null""")
_story = (RAW, CLEANED, SCORED, COMPONENTS)
add("story_components", *_story, recursive=True, select="select global_event_id, story_id from members")
add("story_clusters", *_story, STORIES, recursive=True, select=f"select story_id, {STORY_TEXT} from stories")
add("story_event_ids", *_story, recursive=True, select="""
select story_id, global_event_id from members""")
add("story_labels", *_story, STORIES, LABELLED, recursive=True, select="""
select story_id, member_count, label, summary from labelled""")
add("story_metrics", *_story, STORIES, LABELLED, recursive=True, select="""
select cast(sum(member_count) as bigint) as events, count(*) as clusters,
  count(*) filter (where member_count > 1) as multi_member_clusters, count(label) as labels,
  round(count(*) / sum(member_count), 3) as dedup_ratio from labelled""")
add("story_docs", *_story, STORIES, LABELLED, """doc_ids as (
  select story_id, sha1(concat_ws(',', count(*), sum(q0)::bigint, sum(q1)::bigint, sum(q2)::bigint, sum(q3)::bigint))
    as doc_id
  from (select story_id, ('0x' || m[1:8])::bigint as q0, ('0x' || m[9:16])::bigint as q1,
      ('0x' || m[17:24])::bigint as q2, ('0x' || m[25:32])::bigint as q3
    from (select story_id, md5(cast(global_event_id as varchar)) as m from members)) group by story_id)""", recursive=True, select=f"""
select doc_id as id, trim(trim(rep_title) || ' ' || trim(summary)) as document, rep_title as title, summary,
  coalesce(rep_url, '') as source_url, coalesce(country_code, '') as country_code,
  {ISO.format('latest')} as date_added from labelled join doc_ids using (story_id)""")
_prompt = quote(LABEL_PROMPT).replace("\n", "' || chr(10) || '")
add("label_prompts", *_story, recursive=True, select=f"""
select story_id, {_prompt} || array_to_string(list_transform(list(title order by f)[1:8], lambda t: '- ' || t), chr(10))
  as prompt
from (select story_id, trim(page_title) as title, min(global_event_id) as f from members group by 1, 2)
where story_id in (select story_id from members group by 1 having count(*) > 1) group by story_id""")
add("clean_labels", f"""answers as (
  select page_id, case page_id % 5 when 0 then '  "' || t || '"  ' when 1 then '''' || t || '..' || chr(10) || 'rest'
    when 2 then '  ' || chr(10) || ' ' when 3 then t || chr(10) || t else '"''' || t || '.''"' end as a
  from (select page_id, {inputs.TITLE} as t from pages))""", select="""
select page_id, nullif(rtrim(trim(string_split(
  trim(trim(trim(a, ' ' || chr(10)), '"'), ''''), chr(10))[1]), '.'), '') as label from answers""")
add("story_trend", RAW, CLEANED, SCORED, """dated as (
  select *, date_trunc('day', date_added)::timestamp + interval 1 day as run_at from scored),
sums as (
  select run_at, action_geo_country_code,
    cast(sum(case when date_added >= run_at - interval 1 hour then coalesce(num_articles, 0) else 0 end) as bigint)
      as articles_last_hour,
    cast(sum(case when date_added >= run_at - interval 2 hour and date_added < run_at - interval 1 hour
      then coalesce(num_articles, 0) else 0 end) as bigint) as articles_prev_hour
  from dated group by 1, 2)""", select="""
select cast(run_at as varchar) as run_at, action_geo_country_code, articles_last_hour, articles_prev_hour,
  case when articles_last_hour > articles_prev_hour * 1.2 then 'rising'
       when articles_last_hour < articles_prev_hour * 0.8 then 'falling' else 'steady' end as trend from sums""")
_runs = (RAW, CLEANED, SCORED, RUN_STORIES, STORED_STORIES)
LATEST = """latest_stories as (
  select * replace (least(1.0, intensity) as intensity), rep_title as summary from stored_stories
  where run_at = (select max(run_at) from stored_stories) order by intensity desc, story_id limit 500)"""
add("stories_latest", *_runs, LATEST, recursive=True, select=f"select story_id, summary, {STORY_TEXT} from latest_stories")
add("stories_geojson", *_runs, LATEST, """ids as (
  select run_at, story_id, string_agg(cast(global_event_id as varchar), ',' order by global_event_id) as event_ids
  from run_members group by 1, 2)""", recursive=True, select=f"""
select story_id as id, lon as lng, lat, summary as title, total_articles as num_articles, total_sources as num_sources,
  {ISO.format('latest')} as date_added, source_urls[1] as source_url, summary, member_count,
  round(intensity, 6) as intensity, round(avg_tone, 6) as avg_tone, trend, location, country_code,
  array_to_string(source_urls, '|') as source_urls, event_ids, {ISO.format('earliest')} as earliest,
  {ISO.format('run_at')} as run_at from latest_stories join ids using (run_at, story_id)""")
add("story_retention", *_runs, recursive=True, select="""
select cast(run_at as varchar) as run_at, story_id, member_count from stored_stories""")
add("pipeline_stats", *_runs, PARSED, VALID, TITLES, RUNS, recursive=True, select="""
select (select count(*) from scored) as total_events,
  (select count(*) from stored_stories where run_at = (select max(run_at) from stored_stories)) as total_stories,
  cast((select max(run_at) from runs) as varchar) as last_ingestion_at,
  (select arg_max(rows_loaded, run_at) from runs) as last_ingestion_rows""")
add("stories_or_events", *_runs, """shown as (
  select * from stored_stories where run_at = (select max(run_at) from stored_stories)
  order by least(1.0, intensity) desc, story_id limit 800)""", recursive=True, select="""
select * from (
  select 'before' as moment, 'event' as kind, global_event_id as id, page_title as title, lat, lon,
    round(intensity, 6) as intensity, cast(num_articles as bigint) as num_articles
  from scored order by scored.intensity desc, global_event_id limit 1000)
union all
select 'after', 'story', story_id, rep_title, lat, lon, round(intensity, 6), total_articles from shown""")

# --- retrieval --------------------------------------------------------------------------------

ENTRIES = f"""entries as (
  select cast(page_id as varchar) as id, coalesce({inputs.TITLE}, '') as title,
    coalesce({inputs.HEADLINE}, '') as summary, url as source_url, {inputs.COUNTRY_OF_PAGE} as country_code,
    page_id as load_seq from pages)"""
ASKED = f"""asked as (
  select conv_id * 1000 + turn as question_id, {inputs.QUESTION} as question from conversations where role = 'user')"""
_values = ", ".join(
    f"({i}, {quote(code)}, {quote(name)})" for i, (code, name) in enumerate(COUNTRIES)
)
# A name keeps the position of its first row and takes the code of its last row.
NAMED = f"""country_rows(n, code, name) as (values {_values}),
country_names as (
  select name, min(n) as n, arg_max(code, n) as code from country_rows group by name),
named as (
  select question_id, arg_min(code, {{'l': -length(name), 'n': n}}) as country
  from asked join country_names on regexp_matches(question, '(?i)\\b' || regexp_escape(name) || '\\b')
  group by question_id)"""
add("index_upsert", ENTRIES, """all_entries as (
  select * from entries union all
  select * replace ('Updated: ' || title as summary, load_seq + 1000000000 as load_seq) from entries where load_seq % 7 = 0)""",
    select="""
select id, title, summary, load_seq, trim(trim(title) || ' ' || trim(summary)) as document
from (select *, row_number() over (partition by id order by load_seq desc) as rn from all_entries) where rn = 1""")
add("detect_country_codes", ASKED, NAMED, select="""
select question_id, country from asked left join named using (question_id)""")
add("knn_retrieve", """v as (
  select vec_id, lpad(cast(vec_id as varchar), 9, '0') as id, cast(embedding as double[]) as e from embeddings),
ranked as (
  select a.vec_id as question_id, b.id, round(list_dot_product(a.e, b.e), 9) as sim,
    row_number() over (partition by a.vec_id order by round(list_dot_product(a.e, b.e), 9) desc, b.id) as rank
  from v a, v b)""", select="""
select question_id, cast(rank as int) as rank, id, sim as similarity from ranked where rank <= 5""")
KNN = f"""asked_counts as (select *, {EMBED.format('question')} as c from asked),
asked_vectors as (select question_id, question, {unit_vector('c')} as v from asked_counts),
entry_counts as (select *, {EMBED.format("trim(trim(title) || ' ' || trim(summary))")} as c from entries),
entry_vectors as (select * exclude (c), {unit_vector('c')} as v from entry_counts),
sims as (
  select a.question_id, country, e.id, e.country_code, round(list_dot_product(a.v, e.v), 9) as sim
  from asked_vectors a left join named using (question_id), entry_vectors e),
scoped as (
  select *, row_number() over (partition by question_id order by sim desc, id) as rank from sims
  where country = country_code),
unscoped as (
  select *, row_number() over (partition by question_id order by sim desc, id) as rank from sims
  where question_id not in (select question_id from scoped)),
hits as (
  select question_id, true as scoped, rank, id, sim from scoped where rank <= 5
  union all select question_id, false, rank, id, sim from unscoped where rank <= 5)"""
add("knn_country_fallback", ENTRIES, ASKED, NAMED, KNN, select="""
select question_id, scoped, cast(rank as int) as rank, id, sim as similarity from hits""")
_answer = quote(ANSWER_PROMPT + "Context:\n").replace("\n", "' || chr(10) || '")
add("rag_prompts", ENTRIES, ASKED, NAMED, KNN, select=f"""
select question_id, {_answer} || string_agg('- ' || title || case when summary <> '' then ': ' || summary else '' end,
    chr(10) order by rank) || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || 'Answer:' as prompt,
  string_agg(title || ' ' || source_url, '|' order by rank) as sources
from hits join entries using (id) join asked using (question_id) group by question_id""")

# --- streaming --------------------------------------------------------------------------------

add("stream_ingest", RAW, PARSED, VALID, TITLES, """log as (
  select v.*, t.page_title from valid v left join titles t on v.source_url = t.url),
first_load as (
  select *, row_number() over (partition by global_event_id, date_added order by cycle) as rn from log),
last_load as (
  select *, row_number() over (partition by global_event_id, date_added order by cycle desc) as rn from log),
merged as (
  select f.* replace (l.num_mentions as num_mentions, l.num_sources as num_sources, l.num_articles as num_articles,
    l.avg_tone as avg_tone, l.page_title as page_title)
  from first_load f join last_load l on f.global_event_id = l.global_event_id and f.date_added = l.date_added
  where f.rn = 1 and l.rn = 1)""", select=f"""
select strftime(m.date_added, '%Y-%m') as month, {EVENT_TEXT}, page_title from merged m""")
add("stream_titles", RAW, PARSED, VALID, f"""titles as (
  select cycle, source_url as url, arg_max(trim({_entities.format("page_title || ' (' || load_seq || ')'")}), load_seq) as page_title
  from raw where load_seq % 3 <> 0 and page_title is not null group by all)""", select="""
select v.cycle, v.global_event_id, v.num_articles, v.source_url, t.page_title
from valid v left join titles t on v.source_url = t.url and v.cycle = t.cycle""")
add("stream_rate", """hours as (
  select date_trunc('hour', ts)::timestamp as h, count(*) as events from events group by 1)""", select="""
select cast(h as varchar) as window_start, events from hours""")
