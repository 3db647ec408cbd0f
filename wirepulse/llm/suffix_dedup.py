"""Byte strings of a threshold length that occur more than once, by depth-limited radix passes.

The suffixes of all texts are ordered only through their first ``length`` bytes, by passes that each
split the groups of the pass before; a suffix alone in its group is settled and leaves. Groups left
at the full depth are exactly the repeated windows.

The digits aren't read from left to right. The first is the window's anchor: its ``ANCHOR`` bytes
with the smallest hash. Equal windows have equal anchors at equal places, and neighbouring windows
share theirs, so the first pass handles one row for about 70 windows. The second digit is the widest
context of the anchor, everything that windows around it can reach: when it occurs twice all these
windows do. The third pass orders the windows themselves, for anchors that occur in different contexts
only, with one context of each kind.

A context or anchor that is frequent in one task is summed there before the exchange. A frequent anchor
has one more digit before its windows: those that begin near it share the bytes behind it, the others
the bytes before it, and only where these occur twice the windows are ordered. Digits and windows that
occur twice in one task are settled there and one of them stands for all in the exchange, so no task
holds a group of unbounded size. Behind an exchange rows come sorted, and a task holds some megabytes
of whole groups at a time, however much it has read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.common import RangeHash, blocks, in_slices, mix, stored, whole_groups

ANCHOR = 32
BUCKETS = 4096
# An anchor with more contexts in the task that finds them, or over all, is frequent.
FREQUENT, FREQUENT_OVER_ALL = 256, 5_000
# What a task settles at once: rows and bytes of digits, bytes of entries, bytes of texts to be ordered.
_SETTLED, _SETTLED_BYTES = 200_000, 1 << 24
_ENTRY_BYTES, _TEXT_BYTES = 1 << 23, 1 << 20
_BLOCK_BYTES = 1 << 18  # a block's hashes and minima take some hundred times its bytes
_PIECE = 4096  # entries of a row that needs no grouping
_CHUNK = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_SPAN, _COLD, _HOT = 0, 1, 2
_FOUND = "kind int, anchor long, row long, pos int, first int, last int"
_ENTRY = np.dtype(
    [("anchor", "<u8"), ("context", "<u8"), ("row", "<i8"), ("pos", "<i4"), ("lo", "<i4"), ("hi", "<i4"),
     ("first", "u1"), ("last", "u1"), ("flag", "u1")]
)


def anchors(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(position, first window, last window) of the anchors of all windows inside a text."""
    width = length - ANCHOR + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    found = []
    for at in range(0, max(len(data) - length + 1, 0), _CHUNK):
        own = hashes[at : at + _CHUNK + width - 1]
        n = len(own) - width + 1
        keys = (mix(own) & ~_LOW) | np.arange(len(own), dtype=np.uint64)
        keys = np.concatenate([keys, np.full(-len(keys) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(keys, axis=1).ravel()
        back = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64) + at
        starts = np.arange(at, at + n)
        inside = starts + length <= ends[starts]
        found.append((starts[inside], chosen[inside]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    starts, chosen = (np.concatenate(x) for x in zip(*found, strict=True))
    edge = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(edge[1:], len(starts)) - 1
    return chosen[edge], starts[edge], starts[last[: len(edge)]]


def _entries(row: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """An entry for each anchor of a block; positions count from the start of the text."""
    hashed = RangeHash(data)
    runs = hashed.runs(ANCHOR)
    pos, first, last = anchors(data, offsets, runs, length)
    text = np.searchsorted(offsets, pos, "right") - 1
    start, end = offsets[text], offsets[text + 1]
    lo, hi = np.maximum(pos - length + ANCHOR, start), np.minimum(pos + length, end)
    out = np.empty(len(pos), _ENTRY)
    second = RangeHash(data, 1)
    # The smallest mixed hash of a window was chosen: mixed again, anchors are spread over all buckets.
    out["anchor"] = mix(mix(runs[pos]))
    out["context"] = mix(hashed(lo, hi)) ^ mix(second(lo, hi) + ((pos - lo) << 32 | (hi - lo)).astype(np.uint64))
    out["row"], out["pos"], out["lo"], out["hi"] = row[text], pos - start, lo - start, hi - start
    out["first"], out["last"], out["flag"] = pos - first, pos - last, 0
    return out


def _rows(kind: int, e: np.ndarray) -> pa.RecordBatch:
    """Found rows: of a span its ends, of others the anchor's place and its windows."""
    place = e["lo"] if kind == _SPAN else e["pos"]
    first = e["hi"] if kind == _SPAN else e["pos"] - e["first"]
    last = e["hi"] if kind == _SPAN else e["pos"] - e["last"]
    columns = [np.full(len(e), kind, np.int32), e["anchor"].view(np.int64), e["row"], place, first, last]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "anchor", "row", "pos", "first", "last"]
    )


def _pieces(kind: int, e: np.ndarray) -> Iterator[dict]:
    """Entries that need no grouping, spread over the tasks behind the exchange by their rows."""
    for at in range(0, len(e), _PIECE):
        own = e[at : at + _PIECE]
        yield {"bucket": BUCKETS + int(own["row"][0]) % BUCKETS, "kind": kind, "entries": own.tobytes()}


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, size) of the groups of sorted keys."""
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def _summed(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts entries by anchor and context. Returns (sorted entries, first places of the contexts, their
    sizes, whether each context is repeated, number of contexts of each one's anchor)."""
    e = e[np.lexsort((e["row"], e["pos"], e["context"], e["anchor"]))]
    first, size = _groups(mix(e["anchor"]) ^ e["context"])
    flagged = np.maximum.reduceat(e["flag"], first) if len(first) else np.empty(0, np.uint8)
    repeated = (size > 1) | (flagged & 1).astype(bool)
    anchor_first, contexts = _groups(e["anchor"][first])
    return e, first, size, repeated, np.repeat(contexts, contexts)


def found_anchors(df: DataFrame, length: int) -> DataFrame:
    """Of texts (_row, _text): spans that are repeated as a whole, and the anchors whose windows are
    still to be ordered. Flags of entries: 1, the context is repeated; 2, the anchor is frequent."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []

        def flush() -> Iterator[dict]:
            e, first, size, repeated, contexts = _summed(np.concatenate(pending))
            pending.clear()
            spans = e[np.repeat(repeated, size)]
            yield from _pieces(_SPAN, spans)
            rep = e[first]
            rep["flag"] = repeated
            frequent = contexts > FREQUENT
            yield from _pieces(_HOT, rep[frequent])
            one = np.zeros(len(rep), bool)
            one[_groups(rep["anchor"])[0]] = True
            rep["flag"] |= np.where(frequent, 2, 0).astype(np.uint8)
            sent = rep[~frequent | one]
            # A frequent anchor's first context stands for the anchor only.
            bucket = (sent["anchor"] >> np.uint64(52)).astype(np.int64)
            ends = np.searchsorted(bucket, np.arange(BUCKETS + 1))  # sorted by anchor
            for b in np.flatnonzero(np.diff(ends)):
                yield {"bucket": int(b), "kind": -1, "entries": sent[ends[b] : ends[b + 1]].tobytes()}

        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("entries", pa.binary())])
        held = 0
        for rows, data, offsets in blocks(batches, "_text", _BLOCK_BYTES):
            pending.append(_entries(rows.column("_row").to_numpy(zero_copy_only=False), data, offsets, length))
            held += len(pending[-1])
            if held > 500_000:
                yield from in_slices(pa.RecordBatch.from_pylist(list(flush()), schema))
                held = 0
        if pending:
            yield from in_slices(pa.RecordBatch.from_pylist(list(flush()), schema))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "bucket", _ENTRY_BYTES):
            parts = []
            for batch in group:
                for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                    e = np.frombuffer(raw, _ENTRY)
                    if kind < 0:
                        parts.append(e)
                    else:
                        yield _rows(kind, e)
            if not parts:
                continue
            e, first, size, repeated, contexts = _summed(np.concatenate(parts))
            yield _rows(_SPAN, e[np.repeat(repeated & (size > 1), size)])
            rep = e[first]
            frequent = np.maximum.reduceat(e["flag"] & 2, _groups(e["anchor"])[0])
            _, per_anchor = _groups(e["anchor"][first])
            frequent = np.repeat((frequent > 0) | (per_anchor > FREQUENT_OVER_ALL), per_anchor)
            yield _rows(_HOT, rep[frequent])
            yield _rows(_COLD, rep[~frequent & (contexts > 1)])

    schema = "bucket int, kind int, entries binary"
    dealt = df.mapInArrow(emit, schema).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(settle, _FOUND)


def _contexts(df: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(kind, anchor, row, first, k1, k2, text) of the anchors to be ordered: the bytes of their windows.
    A frequent anchor has two parts, windows that begin near it and the others, each with two hashes
    of the bytes that all windows of the part hold."""
    places = (
        found.filter(f"kind <> {_SPAN}").groupBy("row")
        .agg(F.collect_set(F.struct("kind", "anchor", "pos", "first", "last")).alias("places"))
    )
    near = (length - ANCHOR) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "_text"):
            raw = data.tobytes()
            whole: list[tuple[int, ...]] = []  # kind, anchor, row, first, start, end, core start, core end
            for row, at, places in zip(rows.column("_row").to_pylist(), offsets.tolist(), rows.column("places").to_pylist(), strict=False):
                for p in places:
                    pos, first, last = p["pos"], p["first"], p["last"]
                    if p["kind"] == _COLD:
                        whole.append((_COLD, p["anchor"], row, first, at + first, at + last + length, 0, 0))
                        continue
                    middle = pos - near  # the first window that begins near the anchor
                    if last >= middle:
                        a = max(first, middle)
                        whole.append((_HOT, p["anchor"], row, a, at + a, at + last + length, at + pos, at + middle + length))
                    if first < middle:
                        b = min(last, middle - 1)
                        whole.append((_HOT, p["anchor"], row, first, at + first, at + b + length, at + middle - 1, at + pos + ANCHOR))
            if not whole:
                continue
            kind, anchor, row, first, start, end, core, core_end = (np.array(c, np.int64) for c in zip(*whole, strict=True))
            keys = [mix(RangeHash(data, w)(core, core_end) + (core - start == 0).astype(np.uint64)).view(np.int64) for w in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(anchor), pa.array(row), pa.array(first, pa.int32()), pa.array(keys[0]),
                 pa.array(keys[1]), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())],
                ["kind", "anchor", "row", "first", "k1", "k2", "text"],
            )

    schema = "kind int, anchor long, row long, first int, k1 long, k2 long, text binary"
    return df.join(places.withColumnRenamed("row", "_row"), "_row").mapInArrow(cut, schema)


def _settled(keyed: DataFrame, expand=None, schema: str | None = None) -> DataFrame:
    """The rows (k1, k2, ...) whose keys occur more than once. ``expand`` makes such rows, of ``schema``,
    of the batches first.

    A task keeps the rows that it finds repeated and sends one of each key for all of them, marked as
    repeated, beside those that it saw once. So a key has a row from a task in the exchange at most.
    """
    schema = schema or ", ".join(f"{c} {t}" for c, t in keyed.dtypes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
            pending.clear()
            order, start, size = _keys(rows)
            state = np.repeat(np.where(size > 1, 2, 0), size)  # 0 seen once, 1 stands for others, 2 repeated
            again = order[start[size > 1]]
            out = rows.take(pa.array(np.concatenate([order, again])))
            return _with(out, "state", pa.array(np.concatenate([state, np.ones(len(again), np.int64)]), pa.int64()))

        held = size = 0
        for rows in expand(batches) if expand else batches:
            if not rows.num_rows:
                continue
            pending.append(rows)
            held, size = held + rows.num_rows, size + rows.nbytes
            if held > _SETTLED or size > _SETTLED_BYTES:
                yield from in_slices(flush())
                held = size = 0
        if pending:
            yield from in_slices(flush())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "k1", _SETTLED_BYTES):
            rows = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
            order, start, size = _keys(rows)
            once = np.array(rows.column("state"), np.int64)[order] == 0
            yield rows.take(pa.array(order[once & (np.repeat(size, size) > 1)]))

    state = f"{schema}, state long"
    seen = stored(keyed.mapInArrow(first, state), "settled")
    later = seen.filter("state < 2").repartition("k1").sortWithinPartitions("k1").mapInArrow(second, state)
    return seen.filter("state = 2").unionByName(later).drop("state")


def _keys(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, first place of each key in it, number of its rows)."""
    k1, k2 = (np.array(rows.column(c), np.int64) for c in ("k1", "k2"))
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    start = np.flatnonzero(new)
    return order, start, np.diff(np.append(start, len(order)))


def _with(rows: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, column], [*rows.schema.names, name])


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes, row, start) of every window in the texts of a batch."""
    data, offsets = np.frombuffer(b"".join(batch.column("text").to_pylist()), np.uint8), None
    sizes = np.array([len(x) for x in batch.column("text").to_pylist()], np.int64)
    offsets = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    ends = np.cumsum(counts)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    at = within + np.repeat(offsets, counts)
    hashes = [mix(RangeHash(data, w)(at, at + length)) for w in (0, 1)]
    start = within + np.repeat(batch.column("first").to_numpy(), counts)
    return *hashes, np.repeat(batch.column("row").to_numpy(), counts), start


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans (row, lo, hi) of windows, neighbouring ones together."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return pa.RecordBatch.from_pydict(
        {"row": row[first], "lo": start[first].astype(np.int32), "hi": (start[last[: len(first)]] + length).astype(np.int32)}
    )


def repeated_spans(df: DataFrame, length: int = 200) -> DataFrame:
    """(row, lo, hi): byte spans of texts (_row, _text) that lie in repeated windows of ``length``; none
    of an empty table."""
    found = stored(found_anchors(df, length), "anchors")
    contexts = stored(_contexts(df, found, length), "contexts")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole anchors at a time; rows come sorted by them."""
        for group in whole_groups(batches, "anchor", _TEXT_BYTES):
            found = (_windows(b.slice(at, 2000), length) for b in group for at in range(0, b.num_rows, 2000))
            h1, h2, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((h2, h1))
            same = (np.diff(h1[order]) == 0) & (np.diff(h2[order]) == 0)
            twice = np.zeros(len(order), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            yield _runs(row[twice], start[twice], length)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                h1, h2, row, start = _windows(batch.slice(at, 2000), length)
                yield pa.RecordBatch.from_pydict(
                    {"k1": h1.view(np.int64), "k2": h2.view(np.int64), "row": row, "lo": start.astype(np.int32)}
                )

    cold = contexts.filter(f"kind = {_COLD}").repartition("anchor").sortWithinPartitions("anchor")
    cold = cold.select("anchor", "row", "first", "text").mapInArrow(order, "row long, lo int, hi int")
    parts = _settled(contexts.filter(f"kind = {_HOT}").select("k1", "k2", "row", "first", "text"))
    hot = _settled(parts, windows, "k1 long, k2 long, row long, lo int")
    hot = hot.select("row", "lo", (F.col("lo") + length).alias("hi"))
    whole = found.filter(f"kind = {_SPAN}").select("row", F.col("pos").alias("lo"), F.col("last").alias("hi"))
    return whole.unionByName(cold).unionByName(hot)


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, whole_characters: bool = False,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) and the named ``columns`` of each row:
    what is left of its text when every byte in a window that also starts elsewhere is removed.

    Windows lie inside one text; the same text again, and a window that overlaps its copy, count as
    elsewhere. Null texts are empty, texts shorter than ``length`` stay whole. ``kept`` is bytes; with
    ``whole_characters`` spans are narrowed to whole UTF-8 characters and ``kept`` is a string. Rows
    that repeat key and text are each removed as copies of the other.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        *dict.fromkeys((key, *columns)), content.alias("_text"), F.xxhash64(F.col(key), content).alias("_row")
    )
    spans = repeated_spans(rows.select("_row", "_text"), length)
    merged = spans.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))
    joined = rows.join(merged, "_row", "left").drop("_row")
    kept_columns = [c for c in joined.columns if c not in ("_text", "_spans")]
    schema = ", ".join(f"`{c}` {t}" for c, t in joined.select(kept_columns).dtypes)
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept "
    schema += "string" if whole_characters else "binary"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, "_text"):
            out = []
            for at, end, found in zip(offsets[:-1], offsets[1:], batch.column("_spans").to_pylist(), strict=True):
                raw = data[at:end].tobytes()
                runs = merged_runs([(s["lo"], s["hi"]) for s in found or ()])
                if whole_characters:
                    runs = [r for r in (_narrowed(raw, a, b) for a, b in runs) if r[0] < r[1]]
                ends = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append(
                    (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                     kept.decode() if whole_characters else kept)
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if whole_characters else pa.binary()]
            results = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept_columns), *results],
                [*kept_columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return joined.select(*kept_columns, "_text", "_spans").mapInArrow(remove, schema)


def merged_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _narrowed(raw: bytes, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and raw[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi
