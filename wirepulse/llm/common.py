"""Helpers of the operators: tables, blocks of texts in Arrow tasks, word scans and hashes.

Word scans work on the UTF-8 bytes of many texts at once. A hash has 64 bits; where two texts are
called equal across a whole corpus, the operators use two independent ones or compare the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.session import fresh_path

# Words are the runs of characters outside this set, in Java and RE2 notation alike.
WORD_GAP = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# With this setting a query's shuffle files go when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows that go to a Python worker at once: a batch of 10,000 long texts is held outside the heap by the
# executor and again by the worker.
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; cuts the lineage. Nothing reads the
    shuffle files of the write again, so they are removed at its end."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = {key: spark.conf.get(key, None) for key in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    if not 0 < int(before[_BATCH] or 0) < _BATCH_ROWS:
        spark.conf.set(_BATCH, str(_BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a column expression inside a lambda
    function is otherwise evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the ``n + 1`` offsets; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most ``most`` bytes of text, or of a single longer row. Memory that
    is free at the end of a task is given back, since the next task's worker is the same process."""
    yield from _blocks(batches, column, most)
    pa.default_memory_pool().release_unused()


def _blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (
                batch.slice(first, last - first),
                data[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that come sorted by a whole-number column, in parts of about ``most`` bytes. Rows of one
    value stay together, so only a single larger group makes a larger part."""
    waiting: list[pa.RecordBatch] = []
    held, last = 0, None
    for rows in batches:
        for batch in in_slices(rows, most):
            keys = np.array(batch.column(column), np.int64)
            held += batch.nbytes
            if held > most:
                new = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if new:
                    waiting.append(batch.slice(0, new))
                if new or (waiting and keys[0] != last):
                    yield waiting
                    waiting, batch = [], batch.slice(new)
                    held = batch.nbytes
            waiting.append(batch)
            last = keys[-1]
    if waiting:
        yield waiting


def in_slices(rows: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes: what reads them from the worker holds a slice at a time."""
    step = max(rows.num_rows * most // max(rows.nbytes, 1), 1)
    for at in range(0, rows.num_rows, step):
        yield rows.slice(at, step)


# Hashing: a polynomial over random byte values modulo 2**64, so that the hash of any byte range
# follows from prefix sums.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[:128] = [not chr(c).isalnum() for c in range(128)]
_RANDOM = np.random.default_rng(20240501)
_VALUES = _RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_MOST_POWERS = 1 << 21  # kept by a worker; those of a longer text go with it


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least ``n`` of them."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        pair = []
        for x in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, x, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                pair.append(np.multiply.accumulate(out))
        if size > _MOST_POWERS:
            return pair[0], pair[1]
        _POWERS[which] = tuple(pair)
    up, down = _POWERS[which]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        return h ^ (h >> np.uint64(31))


class RangeHash:
    """Hashes of byte ranges of one block."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self._down = _powers(which, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[which][data] * up[:-1], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._sums[ends] - self._sums[starts]) * self._down[starts]

    def runs(self, length: int) -> np.ndarray:
        """Hash of the range of ``length`` bytes that starts at each position."""
        n = len(self._sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self._sums[length:] - self._sums[:n]) * self._down[:n]


class Words:
    """Words of a block: starts, ends, hashes, and the first word of each text (n + 1 numbers)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, plain: bool = False):
        gap = _WHITE[data]
        if plain:
            gap |= _PUNCTUATION[data]
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~gap
        cut = np.zeros(len(data) + 2, bool)
        cut[offsets + 1] = True
        at = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[1:]))
        self.starts = at[at < len(data)]
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:]))
        self.ends = ends
        self.first = np.searchsorted(self.starts, offsets)
        self.range_hash = RangeHash(_LOWER[data] if lower else data)
        self.hashes = mix(self.range_hash(self.starts, self.ends))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text and their n + 1 offsets. A text with fewer
    words has its whole sequence as the only one; without words it has none."""
    counts = words.counts
    n = len(words.hashes)
    with np.errstate(over="ignore"):
        factor = np.uint64(_BASES[0])
        whole = np.zeros(n, np.uint64)
        if n >= size:
            for j in range(size):
                whole[: n - size + 1] = whole[: n - size + 1] * factor + words.hashes[j : n - size + 1 + j]
        whole = mix(whole)
        per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        index = np.arange(offsets[-1]) + np.repeat(words.first[:-1] - offsets[:-1], per_text)
        out = whole[index]
        for t in np.flatnonzero((counts > 0) & (counts < size)):
            h = np.uint64(counts[t])
            for x in words.hashes[words.first[t] : words.first[t + 1]]:
                h = h * factor + x
            out[offsets[t]] = mix(np.array([h]))[0]
    return out, offsets
