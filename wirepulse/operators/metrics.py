"""Ingestion runs: cycle metrics, cycle counts, missing cycles, request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.functions.timegrid import CYCLE_MINUTES, cycle_key, floor_minutes
from wirepulse.operators.ranking import top_k_per_group
from wirepulse.operators.validate import DUPLICATE, rule_reason
from wirepulse.schemas import RUN_SCHEMA


def run_metrics(classified: DataFrame, titles: DataFrame, batch: str = "cycle") -> DataFrame:
    """One row per cycle: fetched, parsed, rejected, loaded, titles matched, drops by reason.

    ``classified`` are parsed lines with their reject reason, ``titles`` is (url, page_title). The
    lines are read once: they shrink to one row per (cycle, reason) and per loaded event id, which
    keeps the URL of its last line, and everything else is computed from those rows.
    """
    parse = F.col("reason")
    judged = classified.withColumn("_rule", F.when(parse.isNull(), rule_reason()))
    valid = parse.isNull() & F.col("_rule").isNull()
    per_id = (
        judged.groupBy(
            batch, parse.alias("_parse"), "_rule", F.when(valid, F.col("global_event_id")).alias("_id")
        )
        .agg(F.count("*").alias("n"), F.max_by("source_url", "line_no").alias("url"))
        # Rows without URL get a key of their own, so they do not meet in one task of the join.
        .withColumn("_url", F.when(F.col("_id").isNotNull(), F.col("url")))
        .withColumn("_url", F.coalesce("_url", F.concat(F.lit("\0"), F.coalesce("_id", F.lit(0)))))
    )
    has_title = titles.select(F.col("url").alias("_url"), F.lit(1).alias("_titled"))
    per_reason = (
        per_id.join(has_title, "_url", "left")
        .groupBy(batch, "_parse", "_rule")
        .agg(
            F.sum("n").alias("rows"),
            F.count("_id").alias("ids"),
            F.count(F.when(F.col("_id").isNotNull(), F.col("_titled"))).alias("titled"),
        )
    )
    good = F.col("_parse").isNull()
    rule = F.when(good, F.coalesce("_rule", F.lit(DUPLICATE)))
    return (
        per_reason.groupBy(batch)
        .agg(
            F.sum("rows").alias("rows_fetched"),
            F.coalesce(F.sum(F.when(good, F.col("rows"))), F.lit(0)).alias("rows_parsed"),
            F.sum("ids").alias("rows_loaded"),
            F.sum("titled").alias("titles_matched"),
            _drops(F.col("_parse"), F.col("rows")).alias("parse_drops"),
            # Of the valid rows, all but one per id were repeats.
            _drops(rule, F.col("rows") - F.col("ids")).alias("validation_drops"),
        )
        .withColumn("rows_rejected", F.col("rows_fetched") - F.col("rows_loaded"))
        .select(
            batch, "rows_fetched", "rows_parsed", "rows_rejected", "rows_loaded",
            "titles_matched", "parse_drops", "validation_drops",
        )
    )


def _drops(reason: Column, rows: Column) -> Column:
    """Map reason -> rows; the number of reasons is fixed."""
    pairs = F.filter(
        F.array_sort(F.collect_list(F.struct(reason.alias("reason"), rows.alias("rows")))),
        lambda p: p["reason"].isNotNull() & (p["rows"] > 0),
    )
    return F.map_from_entries(pairs)


def append_run(metrics: DataFrame, path: str, source: str, seconds: Column | None = None) -> None:
    """Append run rows (``run_at`` is the cycle's time) to the metrics log."""
    duration = seconds if seconds is not None else F.lit(0.0)
    columns = [c.split()[0] for c in RUN_SCHEMA.split(", ")]  # no blank inside a type
    metrics.withColumns({"source": F.lit(source), "duration_seconds": duration}).select(columns).write.mode(
        "append"
    ).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def cycle_counts(events: DataFrame) -> DataFrame:
    """(cycle, rows) per quarter hour that has rows."""
    return events.groupBy(cycle_key(F.col("date_added")).alias("cycle")).agg(
        F.count("*").alias("rows")
    )


def missing_cycles(events: DataFrame) -> DataFrame:
    """Quarter hours between the first and the last event without any row; these need backfill."""
    slots = events.select(floor_minutes(F.col("date_added")).alias("slot"))
    span = slots.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).filter("lo is not null")
    step = F.make_dt_interval(mins=F.lit(CYCLE_MINUTES))
    expected = span.select(F.explode(F.sequence("lo", "hi", step)).alias("slot"))
    return expected.join(slots.distinct(), "slot", "left_anti").select(
        F.date_format("slot", "yyyyMMddHHmmss").alias("cycle")
    )


def _window_start(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("bigint") * seconds


def rate_limit_audit(
    requests: DataFrame, limit: int = 10, window_seconds: int = 60
) -> DataFrame:
    """(user_id, window_start, requests, rejected) of users above ``limit`` in a fixed window."""
    return (
        requests.groupBy(
            "user_id",
            F.timestamp_seconds(_window_start(F.col("ts"), window_seconds))
            .cast("timestamp_ntz")
            .alias("window_start"),
        )
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .withColumn("rejected", F.col("requests") - limit)
    )


def over_limit(counts: DataFrame, limit: int = 10) -> DataFrame:
    """(user_id, window_start, requests, rejected) from counts per user and window, as a stream keeps them."""
    over = counts.withColumnRenamed("events", "requests").filter(F.col("requests") > limit)
    return over.select("user_id", "window_start", "requests", (F.col("requests") - limit).alias("rejected"))


def rejected_requests(
    requests: DataFrame, limit: int = 10, window_seconds: int = 60
) -> DataFrame:
    """Every request after the first ``limit`` of its user and window, with ``retry_after``.

    Only the ``limit``-th request of busy windows is looked up (bounded, salted top-k); the
    others are compared with it instead of ranking a busy user's whole window in one task.
    ``requests`` has request_id, user_id, ts.
    """
    slotted = requests.withColumn("_slot", _window_start(F.col("ts"), window_seconds))
    last_allowed = (
        top_k_per_group(
            slotted.select("user_id", "_slot", "ts", "request_id"),
            ["user_id", "_slot"], [F.asc("ts"), F.asc("request_id")], limit, ["request_id"],
            rank="rn",
        )
        .filter(F.col("rn") == limit)
        .select("user_id", "_slot", F.struct("ts", "request_id").alias("_last"))
    )
    elapsed = F.unix_seconds(F.col("ts").cast("timestamp")) - F.col("_slot")
    return (
        slotted.join(last_allowed, ["user_id", "_slot"])
        .filter(F.struct("ts", "request_id") > F.col("_last"))
        .select("request_id", "user_id", "ts", (F.lit(window_seconds) - elapsed).alias("retry_after"))
    )
