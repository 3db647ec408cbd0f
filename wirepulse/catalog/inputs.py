"""News events derived from the driver's tables.

The expressions of this module run unchanged in Spark and in DuckDB; they only prepare inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.functions.scoring import latest
from wirepulse.sources.event_export import EXPORT_FIELDS, POSITIONS

# Column -> expression over events (plus k, the number in props).
EVENT_EXPRESSIONS = {
    "global_event_id": "case when event_id % 10 = 9 then event_id - 1 else event_id end",
    "event_date": "cast(date_trunc('day', ts) as {ntz})",
    "date_added": "cast(date_trunc('second', ts) as {ntz})",
    "actor1_name": "upper(event_type)",
    "actor2_name": "case when user_id % 3 = 0 then null else concat('USER', cast(user_id as string)) end",
    "event_code": "case when event_id % 89 = 0 then '' when event_id % 97 = 0 then '000' "
    "else concat(lpad(cast(k % 20 + 1 as string), 2, '0'), cast(event_id % 9 + 1 as string)) end",
    "event_root_code": "case when event_id % 97 = 0 then '00' else lpad(cast(k % 20 + 1 as string), 2, '0') end",
    "quad_class": "cast(event_id % 4 + 1 as int)",
    "num_mentions": "cast(floor(value) as int) + k",
    "num_sources": "case when event_id % 107 = 0 then null else k % 30 end",
    "num_articles": "case when event_id % 101 = 0 then -1 when event_id % 103 = 0 then null "
    "else cast(floor(value) as int) end",
    "avg_tone": "case when event_id % 109 = 0 then null else cast(k - 50 as double) / 5 end",
    "action_geo_full_name": "concat(case k % 5 when 0 then 'United States' when 1 then 'India' "
    "when 2 then 'United Kingdom' when 3 then 'France' else 'Japan' end, ', Region ', "
    "cast(event_id % 7 as string))",
    "action_geo_country_code": "case k % 5 when 0 then 'US' when 1 then 'IN' when 2 then 'UK' "
    "when 3 then 'FR' else 'JA' end",
    "lat": "case when event_id % 53 = 0 then null when event_id % 59 = 0 then cast(95.5 as double) "
    "when event_id % 61 = 0 then cast(0 as double) "
    "else cast(event_id * 37 % 1600 as double) / 10 - 80 end",
    "lon": "case when event_id % 61 = 0 then cast(0 as double) "
    "else cast(event_id * 73 % 3400 as double) / 10 - 170 end",
}
# Bookkeeping columns of the landing log.
LOG_EXPRESSIONS = {
    "ingested_at": "cast(date_trunc('day', ts) as {ntz}) + interval '1' day",
    "load_seq": "event_id",
    "cycle": "cast(cast(date_trunc('day', ts) as date) as string)",
}
TITLE = "nullif(trim(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&')), '')"
HEADLINE = "nullif(trim(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&')), '')"
COUNTRY_OF_PAGE = (
    "case page_id % 5 when 0 then 'US' when 1 then 'IN' when 2 then 'UK' when 3 then 'FR' else 'JA' end"
)
QUESTION = (
    "concat('What is happening in ', case conv_id % 6 when 0 then 'India' when 1 then 'France' "
    "when 2 then 'Japan' when 3 then 'the United Kingdom' when 4 then 'the United States' "
    "else 'Zimbabwe' end, '? ', text)"
)


def _digits(expr: str) -> str:
    return f"replace(replace(replace({expr}, '-', ''), ' ', ''), ':', '')"


def line_field_expressions() -> dict[int, str]:
    """Text of each used export position, broken on purpose for some rows: a bad id, date or
    latitude."""
    text = {
        "global_event_id": "case when load_seq % 83 = 0 then 'not-a-number' else cast(global_event_id as string) end",
        "event_date": "case when load_seq % 73 = 0 then '99999999' else "
        + _digits("cast(cast(event_date as date) as string)") + " end",
        "date_added": _digits("cast(date_added as string)"),
        "lat": "case when load_seq % 79 = 0 then '12.3.4' else coalesce(cast(lat as string), '') end",
    }
    fields = {}
    for name, position in POSITIONS.items():
        fields[position] = text.get(name, f"coalesce(cast({name} as string), '')")
    return fields


# One export line: 61 tab-separated fields, one field short for some rows, blank for others.
def line_expression(tab: str) -> str:
    fields = line_field_expressions()
    parts = [fields.get(i, "''") for i in range(EXPORT_FIELDS)]
    full = f"concat_ws({tab}, {', '.join(parts)})"
    short = f"concat_ws({tab}, {', '.join(parts[:-1])})"
    return (
        f"case when load_seq % 67 = 0 then '   ' when load_seq % 71 = 0 then {short} else {full} end"
    )


# Declared schemas of the tables that are read; no file is opened to infer them.
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


# Tables whose rows are spread by this key when they arrive in fewer splits than there are cores.
SPREAD_KEYS = {"events": "event_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A driver table. A small one is a single file with a single row group, which would leave
    all cores but one idle; a table with enough splits is scanned as it is, without a shuffle."""
    df = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and name in SPREAD_KEYS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, SPREAD_KEYS[name])
    return df


def newest(spark: SparkSession, sf_dir: str) -> Column:
    """The newest event time as a scalar subquery, in place of the wall clock."""
    times = EVENT_EXPRESSIONS["date_added"].format(ntz="timestamp_ntz")
    return latest(table(spark, sf_dir, "events", spread=False).selectExpr(f"{times} as date_added"))


def pages_with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url as source_url", f"{TITLE} as page_title"
    )


def raw_events(spark: SparkSession, sf_dir: str, titles: bool = True) -> DataFrame:
    """Landing log rows, one per event, bad rows and re-emissions included.

    ``titles=False`` leaves URL and title NULL and does not touch ``pages``.
    """
    events = table(spark, sf_dir, "events").selectExpr(
        "*", "cast(regexp_extract(props, '[0-9]+', 0) as int) as k"
    )
    columns = [
        f"{expr.format(ntz='timestamp_ntz')} as {name}"
        for name, expr in {**EVENT_EXPRESSIONS, **LOG_EXPRESSIONS}.items()
    ]
    if not titles:
        return events.selectExpr(
            *columns, "cast(null as string) as source_url", "cast(null as string) as page_title"
        )
    n_pages = table(spark, sf_dir, "pages", spread=False).agg(F.count("*")).scalar()
    page_id = F.when(F.col("event_id") % 43 != 0, F.col("event_id") % n_pages)
    rows = events.withColumn("page_id", page_id).selectExpr(*columns, "page_id")
    return rows.join(pages_with_titles(spark, sf_dir), "page_id", "left").drop("page_id")


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid landing rows spread over half a year, for months, rollups and retention."""
    raw = raw_events(spark, sf_dir, titles=False)
    shifted = F.col("date_added") - F.make_dt_interval(days=(F.col("load_seq") % 6 * 30).cast("int"))
    return raw.withColumn("date_added", shifted)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cycle, line_no, value): the events as export lines; the day is the cycle."""
    lines = raw_events(spark, sf_dir).selectExpr(
        "cycle", "load_seq as line_no", line_expression("'\\t'") + " as _line"
    )
    # A generator builds each line once, like a scan would, instead of once per mention.
    once = F.inline_outer(F.array(F.struct(F.col("_line").alias("value"))))
    return lines.select("cycle", "line_no", once)


def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cycle, line_no, value): one article line per page; some are sent again with a new title."""
    pages = table(spark, sf_dir, "pages")
    title = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"

    def lines(rows: DataFrame, text: str, offset: str) -> DataFrame:
        fields = ["''"] * 27
        fields[4] = "url"
        fields[26] = f"concat('<EXTRAS><PAGE_TITLE>', {text}, '</PAGE_TITLE></EXTRAS>')"
        return rows.selectExpr(
            "'all' as cycle", f"{offset} as line_no", f"concat_ws('\\t', {', '.join(fields)}) as value"
        )

    again = pages.filter("page_id % 7 = 0")
    return lines(pages, title, "page_id").unionByName(
        lines(again, f"concat({title}, ' (updated)')", "1000000000 + page_id")
    )


def cycle_title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cycle, line_no, value): article lines of each cycle for two of three events, with the number of
    the event in the title, so that a URL has other titles in other cycles."""
    fields = ["''"] * 27
    fields[4] = "source_url"
    fields[26] = "concat('<PAGE_TITLE>', page_title, ' (', cast(load_seq as string), ')</PAGE_TITLE>')"
    return raw_events(spark, sf_dir).filter("load_seq % 3 <> 0 and page_title is not null").selectExpr(
        "cycle", "load_seq as line_no", f"concat_ws('\t', {', '.join(fields)}) as value"
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries, one per page."""
    return table(spark, sf_dir, "pages").selectExpr(
        "cast(page_id as string) as id",
        f"coalesce({TITLE}, '') as title",
        f"coalesce({HEADLINE}, '') as summary",
        "url as source_url",
        f"{COUNTRY_OF_PAGE} as country_code",
        "page_id as load_seq",
        "'2024-01-01T00:00:00+00:00' as date_added",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per user turn of the conversations."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").selectExpr(
        "conv_id * 1000 + turn as question_id", f"{QUESTION} as question"
    )


# Map requests, one per supplier; ids with certain remainders are malformed in one way each.
REQUEST_EXPRESSIONS = {
    "request_id": "s_suppkey",
    "bbox": "case when s_suppkey % 31 = 0 then '1,2,3' when s_suppkey % 29 = 0 then 'a,b,c,d' "
    "when s_suppkey % 23 = 0 then '-200,35,30,60' when s_suppkey % 19 = 0 then '-10,-95,30,60' "
    "when s_suppkey % 17 = 0 then '-10,70,30,60' when s_suppkey % 7 = 0 then null "
    "else concat_ws(',', cast(s_nationkey * 12 - 170 as string), cast(s_suppkey % 12 * 10 - 70 as string), "
    "cast(s_nationkey * 12 - 130 as string), cast(s_suppkey % 12 * 10 - 40 as string)) end",
    "start_day": "case when s_suppkey % 3 = 0 then null else cast(1 + s_suppkey % 20 as int) end",
    "end_day": "case when s_suppkey % 41 = 0 then 0 when s_suppkey % 4 = 0 then null "
    "else cast(6 + s_suppkey % 20 as int) end",
    "at_day": "case when s_suppkey % 2 = 0 then null else cast(7 + s_suppkey % 20 as int) end",
    "category": "case when s_suppkey % 37 = 0 then '99' when s_suppkey % 5 = 0 then null "
    "else lpad(cast(s_nationkey % 20 + 1 as string), 2, '0') end",
    "theme": "case when s_suppkey % 43 = 0 then 'sports' when s_suppkey % 3 = 1 then 'conflict' "
    "when s_suppkey % 3 = 2 then 'diplomacy' else null end",
    "lim": "case when s_suppkey % 47 = 0 then 0 when s_suppkey % 53 = 0 then 99999 "
    "else cast(5 + s_suppkey % 40 as int) end",
}


def map_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows with bbox text, start, end, at, categories, themes and limit."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        *[f"{e} as {n}" for n, e in REQUEST_EXPRESSIONS.items()]
    )
    day = lambda c: (
        F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col(c))
    )
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return rows.select(
        "request_id", "bbox",
        day("start_day").alias("start"), day("end_day").alias("end"), day("at_day").alias("at"),
        one("category").alias("categories"), one("theme").alias("themes"),
        F.col("lim").alias("limit"),
    )
