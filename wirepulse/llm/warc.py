"""WARC archives of page rows in seekable Zstandard files.

Records are gathered into independent Zstandard frames of about ``FRAME_BYTES``; a skippable frame at
the end holds the seek table (compressed and decompressed size of each frame) in the common seekable
format, so plain decompressors read the file too. A second file maps each record id to its frame and
the offset in it.

Of pages with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest id is written as
a response and the others as revisits that refer to it; a revisit keeps the HTTP header with the
length of the full payload, and its digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_BYTES = 1 << 20
REVISIT_BYTES = 1000
_SEEK_MAGIC, _SKIPPABLE = 0x8F92EAB1, 0x184D2A5E
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "file string, records long, frames long"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def marked_revisits(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``df`` with _digest (hex SHA-1 of the payload, null: empty) and _first: the key of the response
    that a revisit refers to, else null. Only groups of equal payloads join, by digest; a large group
    is a hot key of one row on the other side."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    digested = df.withColumn("_digest", F.sha1(body))
    long_ = digested.filter(F.octet_length(F.coalesce(F.col(payload), F.lit(""))) >= REVISIT_BYTES)
    groups = (
        long_.groupBy("_digest").agg(F.max(key).alias("_last"), F.count("*").alias("_n"))
        .filter("_n > 1").select("_digest", "_last")
    )
    return (
        digested.join(groups, "_digest", "left")
        .withColumn("_first", F.when(F.col("_last") != F.col(key), F.col("_last")))
        .drop("_last")
    )


def record_id(page: int) -> str:
    return f"<urn:page:{page}>"


def _record(page: int, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if first is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines[3:3] = [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class SeekableWriter:
    """Frames of records, then the seek table."""

    def __init__(self, sink):
        import zstandard

        self._compress = zstandard.ZstdCompressor(level=3).compress
        self._sink, self._sizes = sink, []
        self._buffer = bytearray()

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self._buffer and len(self._buffer) + len(record) > FRAME_BYTES:
            self._flush()
        at = len(self._sizes), len(self._buffer)
        self._buffer += record
        return at

    def _flush(self) -> None:
        frame = self._compress(bytes(self._buffer))
        self._sink.write(frame)
        self._sizes.append((len(frame), len(self._buffer)))
        self._buffer.clear()

    def close(self) -> int:
        if self._buffer:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes)
        table += struct.pack("<IBI", len(self._sizes), 0, _SEEK_MAGIC)
        self._sink.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        return len(self._sizes)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of the file."""
    size = source.size()
    n, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != _SEEK_MAGIC:
        raise ValueError("no seek table at the end of the file")
    sizes = struct.unpack(f"<{2 * n}I", source.read_at(8 * n, size - 9 - 8 * n))
    out, at = [], 0
    for small, large in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, small, large))
        at += small
    if at + 8 + 8 * n + 9 != size:
        raise ValueError("the seek table doesn't fit the file")
    return out


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(named fields, block, place of the next record)."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode("utf-8", "surrogateescape").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start = head + 4
    end = start + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, data[start:end], end + 4


def write_warc(df: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row below ``path`` and returns (file, records, frames).

    Null html is an empty payload, null URLs are written as empty, line breaks in them as spaces; a
    null key is left out of no file but written as ``-1``. Rows that repeat a key give a record each,
    and the index leads to each of them. Tasks write under a name of their attempt and rename.
    """
    marked = marked_revisits(df.select(F.coalesce(key, F.lit(-1)).alias(key), url, html), key, html)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}"
        store, base = fs.FileSystem.from_uri(path)
        draft = f"{base}/{name}.try-{task.taskAttemptId()}"
        sink = None
        entries: list[str] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(draft)
                writer = SeekableWriter(sink)
            for page, address, payload, digest, first in zip(
                *(batch.column(c).to_pylist() for c in (key, url, html, "_digest", "_first")), strict=True
            ):
                address = " ".join((address or "").splitlines())
                record = _record(page, address, (payload or "").encode(), digest, first)
                frame, at = writer.add(record)
                entries.append(f"{page}\t{frame}\t{at}\t{len(record)}\n")
        if sink is None:
            return
        frames = writer.close()
        sink.close()
        with store.open_output_stream(f"{draft}.index") as out:
            out.write("".join(entries).encode())
        store.move(f"{draft}.index", f"{base}/{name}.index")
        store.move(draft, f"{base}/{name}.warc.zst")
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [len(entries)], "frames": [frames]})

    written = f"{path}/manifest"
    marked.mapInArrow(write, _FILES).write.parquet(written)
    return df.sparkSession.read.schema(_FILES).parquet(written)


def _frames(path: str, file: str) -> Iterator[bytes]:
    import zstandard

    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{file}.warc.zst") as source:
        for at, small, large in seek_table(source):
            yield zstandard.ZstdDecompressor().decompress(source.read_at(small, at), max_output_size=large)


def read_index(path: str, file: str) -> list[tuple[int, int, int, int]]:
    """(page, frame, offset in the frame, length) of every record of a file."""
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{base}/{file}.index") as source:
        return [tuple(map(int, line.split(b"\t"))) for line in source.readall().splitlines()]


def read_page(path: str, file: str, frame: int, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one record: only its frame is read and decompressed."""
    import zstandard

    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{file}.warc.zst") as source:
        start, small, large = seek_table(source)[frame]
        data = zstandard.ZstdDecompressor().decompress(source.read_at(small, start), max_output_size=large)
    fields, block, _ = parse_record(data[at : at + length])
    return fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    http, payload = block.split(b"\r\n\r\n", 1)
    stated = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't the one that was written")
    number = lambda uri: int(uri[len("<urn:page:") : -1])
    return (
        number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], stated, digest, fields["WARC-Type"],
        number(fields["WARC-Refers-To"]) if revisit else None,
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record; payloads
    of responses are held against their digest. A frame is in memory at a time."""
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for data in _frames(path, file):
                    at, rows = 0, []
                    while at < len(data):
                        fields, block, at = parse_record(data, at)
                        rows.append(_row(fields, block))
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                    )

    files = spark.read.schema(_FILES).parquet(f"{path}/manifest")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(tasks, "file").mapInArrow(read, _RECORDS)
