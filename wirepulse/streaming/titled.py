"""Streaming ingest of two exports at once: events wait for the titles of their own cycle.

Two file streams meet in a left outer join on (cycle, URL). Each title file is parsed once, in the
batch that finds it, in whatever order the two exports of a cycle arrive. A cycle is closed when the
watermark, the newest cycle of the stream that is further behind less ``delay``, has reached it: then its
events are settled (the last line per id), joined and written, and its state goes. So the state holds the
cycles that are still open, not the history. With a delay of one cycle, a cycle closes when both exports of
the next one are there; with none, as soon as a batch has seen both of its own.

Lines of a cycle that is closed already are dropped by Spark and counted (``dropped_rows``);
``delay`` is the time that a late file has. Where no bound is known, use ``ingest.start_ingest``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirepulse.operators.validate import rule_reason
from wirepulse.schemas import EVENT_COLUMNS
from wirepulse.session import settings
from wirepulse.sources.event_export import classify_lines, good_rows
from wirepulse.sources.landing import append_batch, to_landing_rows
from wirepulse.sources.loads import LoadManifest
from wirepulse.sources.text_files import with_file_positions
from wirepulse.sources.title_export import parse_titles
from wirepulse.streaming.rates import stream_name

# Open cycles lie on the disks of the executors and a bounded part of them in memory, however many lines a
# batch finds. A stream that began with another store goes on with it: its checkpoint names the store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
NUMBERED = "cycle string, line_no struct<file: string, block: bigint, row: bigint>, value string"


def cycle_time(cycle: Column) -> Column:
    """The moment a cycle is named after: the digits of its folder or file name up to a dot, a day alone
    being its midnight. Another name is an error, because a line without a time would wait forever."""
    name = F.regexp_extract(cycle, r"([^/.]*)[^/]*$", 1)
    digits = F.rpad(F.regexp_replace(name, "[^0-9]", ""), 14, "0")
    moment = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))
    return F.coalesce(moment, F.raise_error(F.concat(F.lit("not a cycle: "), F.coalesce(cycle, F.lit("null")))))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A split's lines come in their order, so a count over the task orders them."""
    done = 0
    for batch in batches:
        row = pa.array(range(done, done + batch.num_rows), pa.int64())
        done += batch.num_rows
        place = pa.StructArray.from_arrays([batch.column("file"), batch.column("block"), row], ["file", "block", "row"])
        yield pa.RecordBatch.from_arrays([batch.column("cycle"), place, batch.column("value")], ["cycle", "line_no", "value"])


def _lines(spark: SparkSession, path: str, delay: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = with_file_positions(reader.text(path, lineSep="\n")).mapInArrow(_number, NUMBERED)
    return lines.withColumn("cycle_time", cycle_time(F.col("cycle"))).withWatermark("cycle_time", delay)


def settled_events(lines: DataFrame) -> DataFrame:
    """(cycle_time, cycle, event columns): valid rows, the last line per id of each cycle."""
    good = good_rows(classify_lines(lines)).filter(rule_reason().isNull())
    rest = [c for c in EVENT_COLUMNS if c not in ("global_event_id", "page_title")]
    last = F.max_by(F.struct(*rest), "line_no").alias("_last")
    return good.groupBy("cycle_time", "cycle", "global_event_id").agg(last).select(
        "cycle_time", "cycle", "global_event_id", "_last.*"
    )


def titled_events(events: DataFrame, titles: DataFrame) -> DataFrame:
    """Events with the title of their URL in their cycle, or NULL; those without URL have a key of
    their own, so they do not meet in one task."""
    own = F.concat(F.lit("\0"), F.col("global_event_id").cast("string"))
    left = events.withColumn("_url", F.coalesce("source_url", own)).alias("e")
    right = titles.alias("t")
    same = (F.col("e.cycle_time") == F.col("t.cycle_time")) & (F.col("e._url") == F.col("t.url"))
    joined = left.join(right, same, "left_outer")
    columns = ["t.page_title" if c == "page_title" else f"e.{c}" for c in EVENT_COLUMNS]
    return joined.select("e.cycle", *columns)


def _writer(landing_path: str, stream: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, batch_id: int) -> None:
        manifest = LoadManifest(rows.sparkSession, landing_path)
        load = manifest.reserve(stream, batch_id)
        append_batch(to_landing_rows(rows, load.number, F.lit(load.reserved_at).cast("timestamp_ntz")), landing_path)
        manifest.finish(load)

    return write


def start_titled_ingest(
    spark: SparkSession,
    lines_path: str,
    titles_path: str,
    landing_path: str,
    checkpoint_path: str,
    delay: str = "15 minutes",
    interval: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Watch both folders and append closed cycles to the landing log. Without ``interval`` it takes
    what is there and ends; cycles that are open then stay in the state for the next start."""
    events = settled_events(_lines(spark, lines_path, delay, files_per_batch))
    titles = parse_titles(_lines(spark, titles_path, delay, files_per_batch), "cycle_time")
    writer = titled_events(events, titles).writeStream.outputMode("append").foreachBatch(
        _writer(landing_path, stream_name(checkpoint_path))
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    with settings(spark, STATE_STORE):
        return writer.option("checkpointLocation", checkpoint_path).trigger(**trigger).start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after their cycle was closed, in the batches that Spark still reports."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
