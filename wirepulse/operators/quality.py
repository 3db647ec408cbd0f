"""Declarative data tests as a report: unique, not null, accepted values, value range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.dimensions import ROOT_CODES

# The tests of each layer (column, check, accepted values).
SOURCE_CHECKS = [
    ("global_event_id", "unique", None), ("global_event_id", "not_null", None),
    ("date_added", "not_null", None),
]
STAGING_CHECKS = [("global_event_id", "unique", None), ("global_event_id", "not_null", None)]
CLEANED_CHECKS = [
    ("global_event_id", "unique", None), ("global_event_id", "not_null", None),
    ("lat", "not_null", None), ("lon", "not_null", None), ("event_code", "not_null", None),
    ("event_root_code", "not_null", None), ("event_root_code", "accepted_values", ROOT_CODES),
    ("quad_class", "accepted_values", [1, 2, 3, 4]),
]
SCORED_CHECKS = [
    ("global_event_id", "unique", None), ("global_event_id", "not_null", None),
    ("intensity", "not_null", None), ("geom", "not_null", None), ("date_added", "not_null", None),
]


def check_table(df: DataFrame, table: str, checks: list[tuple]) -> DataFrame:
    """(table, column, check, failures).

    ``not_null`` counts rows, ``accepted_values`` distinct foreign values, ``unique`` keys that
    occur more than once. One scan: a row gives a (check, value) pair for each key and each fault, pairs
    are counted with a map-side combine, and the counts of the pairs decide all checks.
    """
    pairs, failures = [], []
    at, n = F.col("pair.at"), F.col("n")
    for i, (column, check, accepted) in enumerate(checks):
        value, here = F.col(column), at == i
        if check == "unique":
            counts, text = value.isNotNull(), value.cast("string")
            failed = F.count_if(here & (n > 1))
        elif check == "not_null":
            counts, text = value.isNull(), F.lit(None).cast("string")
            failed = F.coalesce(F.sum(F.when(here, n)), F.lit(0))
        else:
            counts, text = ~value.isin(accepted), value.cast("string")
            failed = F.count_if(here)
        pairs.append(F.when(counts, F.struct(F.lit(i).alias("at"), text.alias("value"))))
        failures.append(F.struct(
            F.lit(column).alias("column"), F.lit(check).alias("check"), failed.cast("bigint").alias("failures")
        ).alias(f"_{i}"))
    found = df.select(F.explode(F.array(*pairs)).alias("pair")).filter("pair is not null")
    sums = found.groupBy("pair").agg(F.count("*").alias("n")).agg(*failures)
    rows = F.explode(F.array(*[f"_{i}" for i in range(len(checks))])).alias("r")
    return sums.select(rows).select(F.lit(table).alias("table"), "r.*")


def quality_report(raw: DataFrame, staged: DataFrame, cleaned: DataFrame, scored: DataFrame) -> DataFrame:
    located = scored.withColumn(
        "geom", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lon", "lat"))
    )
    return reduce(
        DataFrame.unionByName,
        [
            check_table(raw, "raw_events", SOURCE_CHECKS),
            check_table(staged, "stg_events", STAGING_CHECKS),
            check_table(cleaned, "cleaned_events", CLEANED_CHECKS),
            check_table(located, "events_scored", SCORED_CHECKS),
        ],
    )


def intensity_out_of_range(scored: DataFrame) -> DataFrame:
    """Offending rows; none are expected while the weights sum to 1."""
    return scored.filter((F.col("intensity") < 0) | (F.col("intensity") > 1)).select(
        "global_event_id", "intensity"
    )
