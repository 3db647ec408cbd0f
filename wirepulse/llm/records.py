"""Token ids in length-delimited binary record files, and back.

A record file is a row of frames: length (8 bytes), masked CRC-32C of the length (4), the payload,
masked CRC-32C of the payload (4), all little-endian; readers of this common framing can read them.
A payload is a document's ids, 2 bytes each if the vocabulary allows it, else 4.

Beside each file lies an offset index for reads in any order: a header (``MAGIC``, id width, number
of records) and 24 bytes a record: document id, offset of the frame, number of ids. The manifest, a
Parquet table, has one row a file with its number of records and ids and the ids in files before it.

Documents are range-partitioned and sorted by id; every task writes one file under a name of its
attempt and renames it when it is complete, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirepulse.llm.checksums import crc32c, masked
from wirepulse.llm.common import blocks
from wirepulse.llm.tokens import tokenizer, with_end

MAGIC = 0x58444957
NO_ID = np.iinfo(np.int64).min  # stands for a null document id
_READ = 4 << 20
_FRAME = 16
_MANIFEST = "file string, docs long, tokens long"


def frames(payload: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of all frames of payloads that lie one after another."""
    starts = np.cumsum(lengths) - lengths
    head = lengths.astype("<u8").view(np.uint8)
    places = 8 * np.arange(len(lengths))
    head_sums = masked(crc32c(head, places, np.full(len(lengths), 8))).astype("<u4").tobytes()
    sums = masked(crc32c(payload, starts, lengths)).astype("<u4").tobytes()
    head, body = head.tobytes(), payload.tobytes()
    parts = []
    for i, (start, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        four = slice(4 * i, 4 * i + 4)
        parts += head[8 * i : 8 * i + 8], head_sums[four], body[start : start + n], sums[four]
    return b"".join(parts)


def payloads(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The payloads of frames at ``at``, one after another, after both checks of every frame."""
    stated = np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view("<u8").ravel()
    if not np.array_equal(stated, lengths.astype(np.uint64)):
        raise ValueError("a record's length differs from its index")
    for start, n, sum_at in ((at, np.full(len(at), 8), at + 8), (at + 12, lengths, at + 12 + lengths)):
        sums = np.ascontiguousarray(data[sum_at[:, None] + np.arange(4)]).view("<u4").ravel()
        if not np.array_equal(sums, masked(crc32c(data, start, n))):
            raise ValueError("a record's checksum doesn't fit")
    return np.concatenate(
        [data[:0], *(data[a : a + n] for a, n in zip((at + 12).tolist(), lengths.tolist(), strict=True))]
    )


def write_records(
    df: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = 1
) -> DataFrame:
    """Writes every document's ids and the id ``end`` below ``path`` in ascending ``key`` order and
    returns the manifest. Null texts are empty, null keys come first, rows that repeat a key are
    written one by one in the order of their texts. An empty table gives an empty manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = tokenizer(vocabulary)
        kind = np.dtype("<u2" if encoder.size <= 1 << 16 else "<u4")
        name = f"part-{task.partitionId():06d}"
        store, base = fs.FileSystem.from_uri(path)
        draft = f"{base}/{name}.try-{task.taskAttemptId()}"
        entries: list[np.ndarray] = []
        at = 0
        sink = None
        for rows, data, offsets in blocks(batches, text):
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(draft)
            ids, ends = with_end(*encoder.encode(data, offsets), end)
            counts = np.diff(ends)
            lengths = counts * kind.itemsize
            sink.write(frames(ids.astype(kind).view(np.uint8), lengths))
            keys = rows.column(key).cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            places = at + np.cumsum(lengths + _FRAME) - lengths - _FRAME
            entries.append(np.stack([keys, places, counts], axis=1).astype("<i8"))
            at += int((lengths + _FRAME).sum())
        if sink is None:
            return
        sink.close()
        index = np.concatenate(entries)
        head = np.array([MAGIC, kind.itemsize, len(index)], "<i8")
        with store.open_output_stream(f"{draft}.index") as out:
            out.write(head.tobytes() + index.tobytes())
        store.move(f"{draft}.index", f"{base}/{name}.index")
        store.move(draft, f"{base}/{name}.records")
        yield pa.RecordBatch.from_pydict(
            {"file": [name], "docs": [len(index)], "tokens": [int(index[:, 2].sum())]}
        )

    ordered = df.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    written = f"{path}/manifest"
    ordered.mapInArrow(write, _MANIFEST).write.parquet(written)
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, docs, tokens, start): one row a file, a few hundred bytes for each task of the write."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read_index(path: str, file: str) -> tuple[int, np.ndarray]:
    """(id width, rows of document id, offset and number of ids) of one file."""
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{base}/{file}.index") as source:
        raw = np.frombuffer(source.readall(), "<i8")
    if raw[0] != MAGIC or len(raw) != 3 + 3 * raw[2]:
        raise ValueError(f"{file}.index isn't a whole index")
    return int(raw[1]), raw[3:].reshape(-1, 3)


def read_some(path: str, file: str, numbers: list[int]) -> list[np.ndarray]:
    """The ids of some records of a file, in the order asked for: a read for each, none before it."""
    width, index = read_index(path, file)
    store, base = fs.FileSystem.from_uri(path)
    out = []
    with store.open_input_file(f"{base}/{file}.records") as source:
        for i in numbers:
            n = int(index[i, 2]) * width
            raw = np.frombuffer(source.read_at(n + _FRAME, int(index[i, 1])), np.uint8)
            out.append(payloads(raw, np.zeros(1, np.int64), np.array([n])).view(f"<u{width}"))
    return out


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of every record, all checksums
    verified; ``start`` counts the ids of all records before it. Files are read in pieces."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, start in zip(part.column("file").to_pylist(), part.column("start").to_pylist(), strict=True):
                yield from _pieces(path, file, start, with_ids)

    files = manifest(spark, path).select("file", "start")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "file").mapInArrow(read, schema)


def _pieces(path: str, file: str, start: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    width, index = read_index(path, file)
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{file}.records") as source:
        first = 0
        while first < len(index):
            last = int(np.searchsorted(index[:, 1], index[first, 1] + _READ, "left"))
            last = max(last, first + 1)
            some = index[first:last]
            lengths = some[:, 2] * width
            at = some[:, 1] - some[0, 1]
            raw = np.frombuffer(source.read_at(int(at[-1] + lengths[-1]) + _FRAME, int(some[0, 1])), np.uint8)
            ids = payloads(raw, at, lengths).view(f"<u{width}").astype("<u4")
            ends = np.cumsum(some[:, 2])
            whole = ids.tobytes()
            crcs = [zlib.crc32(whole[4 * (e - n) : 4 * e]) for e, n in zip(ends, some[:, 2], strict=True)]
            columns = [
                pa.array(some[:, 0].copy(), mask=some[:, 0] == NO_ID), pa.array(start + ends - some[:, 2]),
                pa.array(some[:, 2].copy()), pa.array(np.array(crcs, np.int64)),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(bounds, ids.astype(np.int32)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            start += int(ends[-1])
            first = last
