"""Packing of token sequences into fixed windows by the sum-of-squares rule.

Full windows are cut off a long document first. What remains is placed online: among the levels at
which a partly filled window waits, and an empty window, it goes where the sum of the squared counts
of windows per level becomes smallest. An array holds the count of waiting windows of each level.
At the end of a task the emptiest waiting windows are cut up to fill the fullest ones, so that a
task leaves one window with padding at most.

Each input partition is packed by its own task, without a shuffle. The partitions of a file scan are
the same when a lost task runs again, so its windows are too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wirepulse.llm.common import blocks
from wirepulse.llm.tokens import tokenizer, with_end

Piece = tuple[int, int, int]  # document, start in it, length


class SumOfSquares:
    """Windows of ``size`` tokens; ``place`` takes pieces shorter than a window."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)  # waiting windows at each level
        self._waiting: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """The window that the piece completes, if it does."""
        n = piece[2]
        room = self.size - n
        # Moving a window from level h to h + n changes the sum of squares by
        # 2 (counts[h + n] - counts[h]) + 2; full windows and the empty level don't count.
        gain = self.counts[n:] - self.counts[: room + 1] + 1
        gain = 2 * gain
        gain[room] = 1 - 2 * self.counts[room]
        gain[0] = 2 * self.counts[n] + 1
        absent = self.counts[: room + 1] == 0
        absent[0] = False
        gain[absent] = np.iinfo(np.int64).max
        best = int(room - np.argmin(gain[::-1]))  # of equal levels the fullest
        window = self._waiting[best].pop() if best else []
        if best:
            self.counts[best] -= 1
        window.append(piece)
        if best + n == self.size:
            return window
        self.counts[best + n] += 1
        self._waiting[best + n].append(window)
        return None

    def finish(self) -> Iterator[list[Piece]]:
        """The waiting windows: the fullest are filled up with cuts of the emptiest."""
        left = [(h, w) for h in range(1, self.size) for w in self._waiting[h]]
        spare: list[Piece] = []
        low, high = 0, len(left) - 1
        while low <= high:
            level, window = left[high]
            high -= 1
            while level < self.size and (spare or low <= high):
                if not spare:
                    spare = left[low][1]
                    low += 1
                doc, start, n = spare.pop()
                take = min(n, self.size - level)
                window.append((doc, start, take))
                level += take
                if take < n:
                    spare.append((doc, start + take, n - take))
            yield window
        if spare:
            yield spare


def pack_documents(
    df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = 2048, end: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and, if
    asked for, the ids.

    Every document is its ids and the id ``end``; null and empty texts are that id alone. Sequences
    hold at most ``size`` ids and are padded to it. ``ids_crc32`` is over little-endian unsigned
    32-bit ids. Sequence ids are unique, not gapless; rows that repeat a key are packed each by
    itself. ``vocabulary`` is a tokenizer file that every executor has.
    """
    schema = (
        f"{key} {dict(df.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + ", ids array<int>" * with_ids
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36
        encoder = tokenizer(vocabulary)
        packer = SumOfSquares(size)
        # Ids and keys of the documents with a waiting piece, by number; dropped with their window.
        held: dict[int, tuple[object, int, int, np.ndarray]] = {}
        windows = number = 0
        out: list[tuple] = []

        def close(window: list[Piece]) -> None:
            nonlocal windows
            at = 0
            for doc, start, n in window:
                name, total, base, ids = held[doc]
                some = ids[start - base : start - base + n]
                crc = zlib.crc32(some.astype("<u4").tobytes())
                out.append((name, start, n, crc, total, task + windows, at, some))
                at += n
            windows += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(np.array(c, np.int64)) for c in columns[1:7])]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(columns[7]).astype(np.int32)))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        kind = pa.int64()
        for rows, data, offsets in blocks(batches, text):
            kind = rows.column(key).type
            ids, ends = with_end(*encoder.encode(data, offsets), end)
            for i, name in enumerate(rows.column(key).to_pylist()):
                own = ids[ends[i] : ends[i + 1]]
                whole = len(own) // size * size
                held[number] = (name, len(own), 0, own)
                for start in range(0, whole, size):
                    close([(number, start, size)])
                del held[number]
                if whole < len(own):
                    held[number] = (name, len(own), whole, own[whole:].copy())
                    full = packer.place((number, whole, len(own) - whole))
                    if full:
                        close(full)
                        for doc, _, _ in full:
                            del held[doc]
                number += 1
                if len(out) >= 4096:
                    yield flush()
        for window in packer.finish():
            close(window)
            if len(out) >= 4096:
                yield flush()
        if out:
            yield flush()

    return df.select(key, text).mapInArrow(pack, schema)
