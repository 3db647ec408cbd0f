"""Line readers for plain and zipped exports."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = "cycle string, line_no bigint, value string"
CHUNK_LINES = 10_000
# Plain and zipped exports are split by one rule: at every Unicode line boundary. The readers split
# at the line feed; these are the others, after a carriage return that belongs to a line feed.
OTHER_BREAKS = r"[\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def with_file_positions(lines: DataFrame) -> DataFrame:
    """(cycle, file, block, value) for a text scan, batch or streaming.

    The cycle is a ``cycle=...`` folder if the files lie in such, else the file.
    """
    path = F.col("_metadata.file_path")
    cycle = F.col("cycle").cast("string") if "cycle" in lines.columns else path
    # Bad bytes become U+FFFD instead of losing the row.
    text = F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", "")
    return lines.select(
        cycle.alias("cycle"),
        path.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.explode(F.split(text, OTHER_BREAKS)).alias("value"),
    )


def number_lines(positioned: DataFrame) -> DataFrame:
    """(cycle, line_no, value): ``line_no`` orders the lines of a cycle, files by name, splits by
    offset, lines within the split. Apply it directly on the scan (or on a micro-batch)."""
    position = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
    return positioned.select("cycle", position.alias("line_no"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return number_lines(with_file_positions(spark.read.text(path, lineSep="\n")))


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream the first member of each archive in chunks of lines."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                with archive.open(archive.namelist()[0]) as member:
                    text = io.TextIOWrapper(member, "utf-8", errors="replace", newline="\n")
                    chunk: list[str] = []
                    done = 0
                    for line in text:
                        chunk += line.splitlines()
                        if len(chunk) >= CHUNK_LINES:
                            yield _chunk_frame(path, done, chunk)
                            done += len(chunk)
                            chunk = []
                    if chunk:
                        yield _chunk_frame(path, done, chunk)


def _chunk_frame(path: str, start: int, lines: list[str]) -> pd.DataFrame:
    numbers = range(start, start + len(lines))
    return pd.DataFrame({"cycle": path, "line_no": numbers, "value": lines})


def unzip_lines(archives: DataFrame) -> DataFrame:
    """Lines of zipped exports given as (path, content) rows."""
    return archives.select("path", "content").mapInPandas(_unzip, LINE_SCHEMA)


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all archives below ``path``; one small export per archive, one row per line."""
    return unzip_lines(spark.read.format("binaryFile").load(path))


def _zip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, part in batch.groupby("path", sort=True):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                text = "".join(line + "\n" for line in part["value"])
                archive.writestr(f"{name}.csv", text.encode())
            yield pd.DataFrame({"path": [name], "content": [buffer.getvalue()]})


def zip_lines(lines: DataFrame) -> DataFrame:
    """Pack (path, value) rows into archives, one per path and Arrow batch."""
    return lines.select("path", "value").mapInPandas(_zip, "path string, content binary")


def write_zips(archives: DataFrame, path: str) -> DataFrame:
    """Writes (path, content) rows as files below ``path``, named by path and content, and returns
    their names; a task that runs again writes the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names = []
            for name, content in zip(batch["path"], batch["content"]):
                names.append(f"{name}.{hashlib.md5(content).hexdigest()}.zip")
                with store.open_output_stream(f"{base}/{names[-1]}") as sink:
                    sink.write(content)
            yield pd.DataFrame({"file": names})

    return archives.mapInPandas(write, "file string")
