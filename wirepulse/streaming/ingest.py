"""Streaming ingest: new export files are parsed, validated and appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirepulse.plans.ingest import attach_titles
from wirepulse.operators.validate import validate_batch
from wirepulse.sources.event_export import classify_lines, good_rows
from wirepulse.sources.landing import append_batch, to_landing_rows
from wirepulse.sources.loads import LoadManifest
from wirepulse.sources.text_files import number_lines, with_file_positions
from wirepulse.streaming.rates import stream_name


def batch_writer(
    landing_path: str, titles: Callable[[], DataFrame] | None = None, stream: str = "batches"
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function. Each batch of a stream has a load number of its own, reserved when it
    first runs: a replayed batch replaces its own files by equal ones, and no other stream's loads are
    touched, in whatever turns the streams run. Later loads overwrite earlier ones when the log is read."""

    def write(lines: DataFrame, batch_id: int) -> None:
        manifest = LoadManifest(lines.sparkSession, landing_path)
        load = manifest.reserve(stream, batch_id)
        valid = validate_batch(good_rows(classify_lines(number_lines(lines))))
        if titles is not None:
            valid = attach_titles(valid, titles())
        rows = to_landing_rows(valid, load.number, F.lit(load.reserved_at).cast("timestamp_ntz"))
        append_batch(rows, landing_path)
        manifest.finish(load)

    return write


def start_ingest(
    spark: SparkSession,
    lines_path: str,
    landing_path: str,
    checkpoint_path: str,
    titles: Callable[[], DataFrame] | None = None,
    interval: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Watch ``lines_path`` for export files. Without ``interval`` it takes what is there and ends."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = with_file_positions(reader.text(lines_path, lineSep="\n"))
    writer = lines.writeStream.foreachBatch(batch_writer(landing_path, titles, stream_name(checkpoint_path))).option(
        "checkpointLocation", checkpoint_path
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
