"""The 61-column tab-separated event export, by position and without header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.text import strip, strip_to_null
from wirepulse.schemas import EVENT_COLUMNS

# Width of the export and position of each field that is read.
EXPORT_FIELDS = 61
POSITIONS = {
    "global_event_id": 0,
    "event_date": 1,
    "actor1_name": 6,
    "actor2_name": 16,
    "event_code": 26,
    "event_root_code": 28,
    "quad_class": 29,
    "num_mentions": 31,
    "num_sources": 32,
    "num_articles": 33,
    "avg_tone": 34,
    "action_geo_full_name": 52,
    "action_geo_country_code": 53,
    "lat": 56,
    "lon": 57,
    "date_added": 59,
    "source_url": 60,
}
INTEGERS = ["quad_class", "num_mentions", "num_sources", "num_articles"]
DECIMALS = ["avg_tone", "lat", "lon"]
TEXTS = ["actor1_name", "actor2_name", "action_geo_full_name", "action_geo_country_code",
         "source_url"]
CODES = ["event_code", "event_root_code"]

def _integer(text: Column, kind: str) -> Column:
    """``try_cast`` takes an optional sign and digits, nothing else."""
    return text.try_cast(kind)


def _decimal(text: Column) -> Column:
    """``try_cast`` without the forms only a cast would accept, such as ``1d`` or ``0x1p3``."""
    plain = ~text.rlike("[dDfFxXpP]") | text.rlike("(?i)^[+-]?inf(inity)?$")
    return F.when(plain, text.try_cast("double"))


def _timestamp(text: Column, with_time: bool) -> Column:
    digits = 14 if with_time else 8
    part = lambda start, length: F.substring(text, start, length).try_cast("int")
    clock = [part(9, 2), part(11, 2), part(13, 2)] if with_time else [F.lit(0)] * 3
    made = F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2), *clock)
    # Year 0 and second 60 would otherwise be accepted.
    valid = text.rlike(f"^[0-9]{{{digits}}}$") & (part(1, 4) > 0) & (clock[2] < 60)
    return F.when(valid, made)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Typed event columns plus ``reason`` (NULL for a good row) next to ``lines``' own columns.

    Blank lines are left out. One reason per row, in the order column count, id, timestamp,
    numeric field.
    """
    split = lines.filter(strip(F.col("value")) != "").withColumn(
        "_f", F.split("value", "\t", -1)
    )
    field = {name: F.get("_f", F.lit(pos)) for name, pos in POSITIONS.items()}
    texts = split.select(
        *lines.columns,
        F.size("_f").alias("_width"),
        strip(field["global_event_id"]).alias("_id"),
        field["event_date"].alias("_event_date"),
        field["date_added"].alias("_date_added"),
        *[strip_to_null(field[c]).alias(f"_{c}") for c in INTEGERS + DECIMALS],
        *[strip_to_null(field[c]).alias(c) for c in TEXTS],
        *[strip(field[c]).alias(c) for c in CODES],
    )
    typed = texts.select(
        "*",
        _integer(F.col("_id"), "bigint").alias("global_event_id"),
        _timestamp(F.col("_event_date"), with_time=False).alias("event_date"),
        _timestamp(F.col("_date_added"), with_time=True).alias("date_added"),
        *[_integer(F.col(f"_{c}"), "int").alias(c) for c in INTEGERS],
        *[_decimal(F.col(f"_{c}")).alias(c) for c in DECIMALS],
        F.lit(None).cast("string").alias("page_title"),
    )
    bad_number = reduce(
        lambda a, b: a | b,
        [F.col(f"_{c}").isNotNull() & F.col(c).isNull() for c in INTEGERS + DECIMALS],
    )
    reason = (
        F.when(F.col("_width") != EXPORT_FIELDS, "bad_column_count")
        .when(F.col("global_event_id").isNull(), "bad_event_id")
        .when(F.col("event_date").isNull() | F.col("date_added").isNull(), "bad_timestamp")
        .when(bad_number, "bad_numeric_field")
    )
    judged = typed.select(*lines.columns, reason.alias("_reason"), *EVENT_COLUMNS)
    # The generator keeps later filters on parsed columns from being pushed into the parse, where
    # each of them would split the line again.
    row = F.struct(F.col("_reason").alias("reason"), *EVENT_COLUMNS)
    return judged.select(*lines.columns, F.inline_outer(F.array(row)))


def good_rows(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("reason").isNull()).drop("reason", "value")


def reject_counts(classified: DataFrame, *keys: str) -> DataFrame:
    """Rejected rows per reason (and per ``keys``, for example the cycle)."""
    rejected = classified.filter(F.col("reason").isNotNull())
    return rejected.groupBy(*keys, "reason").agg(F.count("*").alias("rows"))
