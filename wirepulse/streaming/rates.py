"""Windowed counts over a stream, complete at any time: late rows and the last window count."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_COUNTS = "source string, batch bigint, window_start timestamp_ntz, events bigint"
Keys = Mapping[str, str]  # name and type of the columns that rows are counted by, besides the window


def stream_name(checkpoint_path: str) -> str:
    """A folder name for what a stream writes; another checkpoint is another stream."""
    return hashlib.md5(checkpoint_path.rstrip("/").encode()).hexdigest()


def window_counts(rows: DataFrame, ts: str, width: str, step: str | None = None, keys: Keys = {}) -> DataFrame:
    """(*keys, window_start, events) of the rows per tumbling or sliding window, and key."""
    timed = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    window = F.window("_ts", width, step) if step else F.window("_ts", width)
    counts = timed.groupBy(window, *keys).agg(F.count("*").alias("events"))
    return counts.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("window_start"), "events")


def start_counts(
    stream: DataFrame, ts: str, width: str, path: str, checkpoint_path: str, step: str | None = None, keys: Keys = {}
) -> StreamingQuery:
    """Append each batch's counts below ``source=<stream>/batch=<n>``. No state is kept and nothing is
    too late; a replayed batch replaces its own files only."""
    own = f"{path}/source={stream_name(checkpoint_path)}"

    def write(rows: DataFrame, batch_id: int) -> None:
        window_counts(rows, ts, width, step, keys).write.mode("overwrite").parquet(f"{own}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    return writer.trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str, keys: Keys = {}) -> DataFrame:
    """(*keys, window_start, events): the counts of all batches and streams summed."""
    schema = ", ".join([*(f"{name} {kind}" for name, kind in keys.items()), _COUNTS])
    counts = spark.read.schema(schema).option("basePath", path).parquet(path)
    return counts.groupBy(*keys, "window_start").agg(F.sum("events").alias("events"))
