"""Parsed events as JSON lines with ISO timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirepulse.schemas import EVENT_COLUMNS, EVENT_SCHEMA

_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def write_events(events: DataFrame, path: str) -> None:
    events.select(*EVENT_COLUMNS).write.mode("overwrite").option(
        "timestampNTZFormat", _TIME_FORMAT
    ).option("ignoreNullFields", "false").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).option("timestampNTZFormat", _TIME_FORMAT).json(path)
