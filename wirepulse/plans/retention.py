"""Retention: roll expired months up, then drop them. Works on catalog tables.

The landing log is a table partitioned by load and month, as ingest writes it; the rollup is a plain table. The rollup is
written before anything is dropped and only adds absent keys, so a run that died in between can
simply be repeated. A late backfill of a month that is already rolled up is not added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wirepulse.functions.timegrid import month_key
from wirepulse.operators.rollup import daily_rollup, expired_rows, first_kept, insert_absent
from wirepulse.params import RetentionParams
from wirepulse.sources.landing import merge_log

# A month has a partition for each of its loads, some thousands; one statement drops many.
SPECS_PER_STATEMENT = 1000


def create_landing_table(log: DataFrame, table: str) -> None:
    """The log as a catalog table in the layout that ingest writes."""
    log.write.mode("append").partitionBy("load_seq", "month").saveAsTable(table)


def expired_partitions(
    spark: SparkSession, table: str, as_of, params: RetentionParams = RetentionParams()
) -> list[dict[str, str]]:
    """Partitions of months before the cutoff, from the catalog's partition list (no data scan)."""
    bound = spark.range(1).select(month_key(first_kept(as_of, params))).first()[0]
    listed = spark.sql(f"SHOW PARTITIONS {table}").collect()
    specs = [dict(part.split("=", 1) for part in row[0].split("/")) for row in listed]
    return sorted((s for s in specs if s["month"] < bound), key=lambda s: sorted(s.items()))


def _partition(spec: dict[str, str]) -> str:
    named = ", ".join(f"{column} = '{value}'" for column, value in spec.items())
    return f"PARTITION ({named})"


def drop_partitions(spark: SparkSession, table: str, specs: list[dict[str, str]]) -> None:
    """Those that are gone already are passed over."""
    for start in range(0, len(specs), SPECS_PER_STATEMENT):
        some = (_partition(spec) for spec in specs[start : start + SPECS_PER_STATEMENT])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(some)}")


def run_retention(
    spark: SparkSession,
    landing: str,
    rollup: str,
    as_of,
    params: RetentionParams = RetentionParams(),
) -> dict:
    """Names of the dropped months and the number of rollup rows written."""
    expired = expired_partitions(spark, landing, as_of, params)
    if not expired:
        return {"partitions_dropped": [], "rollup_rows_written": 0}
    old = merge_log(expired_rows(spark.table(landing), as_of, params))
    new = daily_rollup(old, params).withColumn("rolled_up_at", F.current_timestamp())
    written = Observation()
    if spark.catalog.tableExists(rollup):
        new = insert_absent(spark.table(rollup), new)
    new.observe(written, F.count("*").alias("rows")).write.mode("append").saveAsTable(rollup)
    drop_partitions(spark, landing, expired)
    months = sorted({spec["month"] for spec in expired})
    return {"partitions_dropped": months, "rollup_rows_written": written.get["rows"]}
