"""The raw landing table: an append log of batches, merged when read.

A batch is appended under its own ``load_seq`` and never changes older files. Reading folds the
log to one row per key (``global_event_id``, ``date_added``): the volatile columns come from the
last load, all others from the first. Compaction folds the finished loads into a base for each month;
readers of the current rows merge it with the loads behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.functions.timegrid import month_key, month_start, next_month
from wirepulse.operators.ranking import latest_per_key
from wirepulse.sources.folders import Folder
from wirepulse.sources.loads import LoadManifest
from wirepulse.schemas import EVENT_COLUMNS, KEY_COLUMNS, STABLE_COLUMNS, VOLATILE_COLUMNS


def to_landing_rows(valid: DataFrame, load_seq: int | Column, ingested_at: Column) -> DataFrame:
    """Event columns plus load order, cycle, load time and the month partition."""
    seq = F.lit(load_seq) if isinstance(load_seq, int) else load_seq
    return valid.select(
        *EVENT_COLUMNS,
        ingested_at.alias("ingested_at"),
        seq.cast("bigint").alias("load_seq"),
        "cycle",
        month_key(F.col("date_added")).alias("month"),
    )


def append_batch(rows: DataFrame, path: str) -> None:
    """Write one batch below ``load_seq=<n>/month=<m>``.

    Writing the same batch again replaces its own files only, so a retry changes nothing.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "load_seq", "month"
    ).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # Partition values are read back as declared: the month is text, the load order a bigint.
    log = spark.read.schema(schema).parquet(path)
    return log.withColumns(
        {"load_seq": F.col("load_seq").cast("bigint"), "month": F.col("month").cast("string")}
    )


def merge_log(log: DataFrame) -> DataFrame:
    """One row per key, loads ordered by ``load_seq`` and, within a load, by cycle.

    Both picks are combined map-side, so a hot key stays cheap.

    A NULL in the last load overwrites an earlier value, titles included.
    """
    first = [*STABLE_COLUMNS, "ingested_at"]
    order = F.struct("load_seq", "cycle")
    # The month follows from the key; as a grouping column it lets month filters reach the scan.
    keys = [*KEY_COLUMNS, *(c for c in ("month",) if c in log.columns)]
    merged = log.groupBy(*keys).agg(
        F.max_by(F.struct(*VOLATILE_COLUMNS), order).alias("_last"),
        F.min_by(F.struct(*first), order).alias("_first"),
        F.max(order).alias("_order"),
    )
    picked = merged.select(*keys, "_last.*", "_first.*", "_order.*")
    month = F.col("month") if "month" in keys else month_key(F.col("date_added"))
    return picked.select(
        *EVENT_COLUMNS, "ingested_at", "load_seq", "cycle", month.alias("month")
    )


def _bases(spark: SparkSession, path: str) -> dict[str, int]:
    """Month -> the last load that its base holds, from the names of folders."""
    base = Folder(spark, f"{path}/_base")
    done = {int(n) for n in base.names("_done/*")}
    found: dict[str, int] = {}
    for month, through in (_values(*x) for x in base.nested("month=*/through=*")):
        if int(through) in done:
            found[month] = max(int(through), found.get(month, -1))
    return found


def _values(*names: str) -> list[str]:
    return [n.split("=")[1] for n in names]


def _months_to_fold(spark: SparkSession, path: str, bases: dict[str, int], through: int | None = None) -> list[str]:
    """Months with loads (up to ``through``) behind their base, from the names of folders."""
    loads = (_values(*x) for x in Folder(spark, path).nested("load_seq=*/month=*"))
    return sorted({m for n, m in loads if int(n) > bases.get(m, -1) and (through is None or int(n) <= through)})


def _later(log: DataFrame, bases: dict[str, int]) -> DataFrame:
    """Rows of loads that the base of their month doesn't hold; only partition values decide."""
    held = [x for month, through in bases.items() for x in (F.lit(month), F.lit(through))]
    if not held:
        return log
    return log.filter(F.col("load_seq") > F.coalesce(F.element_at(F.create_map(*held), F.col("month")), F.lit(-1)))


def compact_log(spark: SparkSession, path: str) -> list[str]:
    """Fold the finished loads of a log into a base for each month; returns the months written.

    The base of a month lies in ``_base/month=<m>/through=<n>`` and holds its rows after all loads up to
    ``n``; months without newer loads keep theirs. It counts when ``_base/_done/<n>`` is there, so a run
    that died changes nothing. Loads that are still being written stay above ``n``. The base before the
    newest stays for readers that have begun; older ones go.
    """
    through = LoadManifest(spark, path).finished_through()
    bases = _bases(spark, path)
    months = _months_to_fold(spark, path, bases, through)
    if not months:
        return []
    rows = read_current(spark, path, months, through).withColumn("through", F.lit(through))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "through").parquet(f"{path}/_base")
    base = Folder(spark, f"{path}/_base")
    base.create(f"_done/{through}")
    for month in months:
        for n in base.names(f"month={month}/through=*"):
            if int(n.split("=")[1]) < bases.get(month, -1):
                base.delete(f"month={month}/{n}")
    return months


def read_current(
    spark: SparkSession, path: str, months: list[str] | None = None, through: int | None = None
) -> DataFrame:
    """One row per key as ``merge_log`` gives it, from the bases and the loads behind them, of some months
    or all, up to a load or the last.

    Base rows whose keys come in no later load are passed on as they are: a month without later loads is
    only scanned, and of others only the keys of the later loads, a small side, are compared.
    """
    bases = _bases(spark, path)
    log = read_log(spark, path)
    if months is not None:
        log = log.filter(F.col("month").isin(months))
        bases = {m: n for m, n in bases.items() if m in months}
    if through is not None:
        log = log.filter(F.col("load_seq") <= through)
    later = _later(log, bases)
    if not bases:
        return merge_log(later)
    columns = [*EVENT_COLUMNS, "ingested_at", "load_seq", "cycle", "month"]
    touched = set(_months_to_fold(spark, path, bases, through)) & set(months or bases)
    schema = spark.createDataFrame([], later.schema).select(*columns).schema

    def base(chosen: list[str]) -> DataFrame:
        if not chosen:
            return spark.createDataFrame([], schema)
        paths = [f"{path}/_base/month={m}/through={bases[m]}" for m in chosen]
        rows = spark.read.schema(schema).option("basePath", f"{path}/_base").parquet(*paths)
        return rows.withColumn("month", F.col("month").cast("string")).select(*columns)

    untouched = base([m for m in bases if m not in touched])
    if not touched and not set(_months_to_fold(spark, path, bases, through)) - set(bases):
        return untouched
    keys = later.select(*KEY_COLUMNS).distinct()
    open_base = base([m for m in bases if m in touched])
    again = open_base.join(keys, KEY_COLUMNS, "left_semi").select(*columns)
    merged = merge_log(later.select(*columns).unionByName(again)).select(*columns)
    return untouched.unionByName(open_base.join(keys, KEY_COLUMNS, "left_anti").select(*columns)).unionByName(merged)


def write_monthly(rows: DataFrame, path: str) -> None:
    """Rows as one folder per calendar month, replacing only the months present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "month"
    ).parquet(path)


def to_monthly(legacy: DataFrame) -> DataFrame:
    """Rows of an unpartitioned table ready for ``write_monthly``; the first load of a key stays."""
    unique = latest_per_key(legacy, KEY_COLUMNS, [F.asc("load_seq")])
    return unique.withColumn("month", month_key(F.col("date_added")))


def list_partitions(rows: DataFrame) -> DataFrame:
    """(name, lower, upper, rows) of each month, oldest first."""
    months = rows.groupBy(month_start(F.col("date_added")).alias("lower")).agg(
        F.count("*").alias("rows")
    )
    name = F.concat(F.lit("raw_events_y"), F.year("lower"), F.lit("m"),
                    F.lpad(F.month("lower").cast("string"), 2, "0"))
    return months.select(
        name.alias("name"), "lower", next_month(F.col("lower")).alias("upper"), "rows"
    ).orderBy("lower")


def bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("date_added").alias("lo"), F.max("date_added").alias("hi"))
