"""Repair of conversations whose turns don't alternate.

The turns of a conversation, in order, are aligned with the role initials ``(s?(ua)+)?`` by edits: Keep
(0), Rerole to user or assistant (1), Delete (2), Insert an empty user or assistant turn (5). Blank
turns and repeats must be deleted; a truncated turn that stays costs 5 more. Of all cheapest edits
those with the ASCII-least initials are taken.

All targets with the same start are prefixes of one alternating string, so one Wagner-Fischer table
for each start holds the costs for every feasible length. A row of the table keeps only the band of
cells from which the incumbent cost can still be met, as Ukkonen's cut-off does: cost so far and what
the remaining turns must cost at least, against the cost of a repair made by one plain pass. Each
length of least cost is traced back and the audits are compared.

The alignment needs a few bytes a turn: texts are shuffled once, for the repaired conversation, which a
task reads as a stream behind its audit. Time and memory of one conversation's alignment are its
turns times the width of the band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
_FAR = 1 << 40
_CODES = {"u": 0, "a": 1, "s": 2}
_ROLES = ("user", "assistant")
_WORD = r"[^\x20\x09-\x0D]"
# The last character that is no white space ends a sentence.
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text, dropped) with a fault by CRC-32 of ``key:turn`` modulo 20: 0 drops the
    row, 1 empties the text, 2 removes its full stops, exclamation and question marks, 3 repeats the
    row, 4 sets the role user. Nulls are one space in the checksum, and as role and text. Dropped rows
    are marked, so that a conversation without any other row is still known."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select(
        key, F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault == 0).alias("dropped"), F.when(fault == 3, 2).otherwise(1).alias("_n"),
    )
    return rows.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).drop("_n", "_i")


def _targets(lead: bool, first: int, n: int) -> np.ndarray:
    """Codes of the roles number ``first`` to ``first + n - 1`` of the alternating string."""
    at = np.arange(first, first + n)
    return np.where(at == 0, 2, (at + 1) % 2) if lead else at % 2


def _table(codes: np.ndarray, gone: np.ndarray, cut: np.ndarray, left: np.ndarray, lead: bool, most: int):
    """Rows (first role, costs) of the alignment of the first i turns with the first j roles, each cut
    to the cells from which a cost of ``most`` can be met; None if a row has none."""
    row = np.arange(1 if lead else (most - left[0]) // INSERT + 1, dtype=np.int64) * INSERT
    rows = [(0, row)]
    for i in range(len(codes)):
        lo, before = rows[-1]
        n, room = len(before), most - left[i + 1]
        now = np.full(n + 1 + max(0, room - int(before.min())) // INSERT, _FAR, np.int64)
        now[:n] = before + DELETE
        if not gone[i]:
            now[1 : n + 1] = np.minimum(now[1 : n + 1], before + _changes(codes[i], cut[i], _targets(lead, lo, n)))
        free = now[1:] if lead and lo == 0 else now  # a leading system turn can't be inserted
        steps = np.arange(len(free)) * INSERT
        free[:] = np.minimum.accumulate(free - steps) + steps
        live = np.flatnonzero(now <= room)
        if not len(live):
            return None
        rows.append((lo + int(live[0]), now[live[0] : live[-1] + 1]))
    return rows


def _changes(code: int, cut: bool, targets: np.ndarray) -> np.ndarray:
    """Cost of a turn that stays as each target role."""
    other = np.where(targets == 2, _FAR, REROLE)
    return np.where(targets == code, 0, other) + (TRUNCATED if cut else 0)


def _span(row: tuple[int, np.ndarray], first: int, n: int, none) -> np.ndarray:
    """The part ``first`` to ``first + n - 1`` of a row, with ``none`` outside."""
    lo, values = row
    out = np.full(n, none, values.dtype)
    a, b = max(first, lo), min(first + n, lo + len(values))
    if a < b:
        out[a - first : b - first] = values[a - lo : b - lo]
    return out


def _trace(rows, codes: np.ndarray, gone: np.ndarray, cut: np.ndarray, lead: bool, length: int) -> str:
    """The ASCII-least audit of least cost for one length: cells of cheapest alignments are marked
    backwards, then the least edit that stays on marked cells is taken from the start."""
    n = len(codes)
    marks: list[tuple[int, np.ndarray]] = [(0, np.empty(0, bool))] * (n + 1)
    mark = np.zeros(len(rows[n][1]), bool)
    mark[length - rows[n][0]] = True
    for i in range(n, -1, -1):
        lo, costs = rows[i]
        for j in np.flatnonzero(mark)[::-1].tolist():
            while j > 0 and not (lead and lo + j == 1) and costs[j - 1] + INSERT == costs[j] and not mark[j - 1]:
                j -= 1
                mark[j] = True
        marks[i] = (lo, mark)
        if i:
            first, before = rows[i - 1]
            m = len(before)
            up = _span(marks[i], first, m, False) & (before + DELETE == _span(rows[i], first, m, -1))
            if not gone[i - 1]:
                change = _changes(codes[i - 1], cut[i - 1], _targets(lead, first, m))
                up |= _span(marks[i], first + 1, m, False) & (before + change == _span(rows[i], first + 1, m, -1))
            mark = up
    audit, i, j = [], 0, 0

    def at(i: int, j: int) -> int:
        lo, own = marks[i] if i <= n else (0, np.empty(0, bool))
        return int(rows[i][1][j - lo]) if 0 <= j - lo < len(own) and own[j - lo] else -1

    while (i, j) != (n, length):
        cost = at(i, j)
        if i < n and at(i + 1, j) == cost + DELETE:
            audit.append("D")
            i += 1
        elif j < length and not (lead and j == 0) and at(i, j + 1) == cost + INSERT:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if _targets(lead, j, 1)[0] == codes[i] else "R")
            i, j = i + 1, j + 1
    return "".join(audit)


def cheapest_edits(initials: list[str], gone: list[bool], cut: list[bool]) -> tuple[int, str]:
    """(cost, audit) of the turns with these role initials; ``gone`` must be deleted, ``cut`` are
    truncated. A turn of another initial, or of none, can be reroled or deleted."""
    n = len(initials)
    codes = np.array([_CODES.get(x, 3) for x in initials], np.int64)
    forced, truncated = np.array(gone, bool), np.array(cut, bool)
    # The incumbent: all forced and truncated turns go, the others are reroled where they stand, and
    # at most the last and a lone system turn go too.
    stay = codes[~(forced | truncated)]
    lead = len(stay) > 0 and stay[0] == 2
    plain = _targets(lead, 0, len(stay))
    most = min(2 * n, DELETE * (n - len(stay)) + int((plain != stay).sum()) + 2 * DELETE)
    least = np.where(forced | truncated, DELETE, 0)
    left = np.concatenate([np.cumsum(least[::-1])[::-1], [0]])
    best = (2 * n, "D" * n)
    for lead in (False, True):
        if lead and 2 not in codes[~forced]:
            continue
        most = min(most, best[0])
        rows = _table(codes, forced, truncated, left, lead, most)
        if rows is None:
            continue
        lo, costs = rows[-1]
        lengths = np.arange(lo, lo + len(costs))
        fits = (lengths > 1) & (lengths % 2 == 1) if lead else lengths % 2 == 0
        if not fits.any() or costs[fits].min() > best[0]:
            continue
        cost = int(costs[fits].min())
        for length in lengths[fits & (costs == cost)].tolist():
            best = min(best, (cost, _trace(rows, codes, forced, truncated, lead, length)))
    return best


def _audits(rows: DataFrame, key: str) -> DataFrame:
    """(key, counts, audit) of each conversation, from short rows without texts."""
    kind = rows.schema[key].dataType.simpleString()
    text = F.col("text")
    short = rows.select(
        key, "turn", "role", F.unhex(F.md5(text.cast("binary"))).alias("digest"), "dropped",
        (~text.rlike(_WORD)).alias("blank"), (~text.rlike(_ENDED)).alias("cut"),
    )
    ordered = _in_order(short, key, F.col("digest"))
    names = [key, *COUNTS, "audit"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started, own = None, False, _Turns()
        keys, done, key_type = [], [], pa.null()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *arrays], names)

        for batch in batches:
            key_type = batch.column(0).type
            columns = (batch.column(i).to_pylist() for i in range(7))
            for k, *row in zip(*columns, strict=True):
                if started and k != current:
                    keys.append(current)
                    done.append(own.result())
                    own = _Turns()
                current, started = k, True
                own.add(*row)
            if len(keys) >= 10_000:
                yield flush()
                keys, done = [], []
        if started:
            keys.append(current)
            done.append(own.result())
            yield flush()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return ordered.mapInArrow(judge, f"`{key}` {kind}, {counts}, audit string")


class _Turns:
    """What is kept of the turns of one conversation."""

    def __init__(self) -> None:
        self.initials: list[str] = []
        self.gone: list[bool] = []
        self.cut: list[bool] = []
        self.seen: set[tuple[str, bytes]] = set()
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, digest: bytes, dropped: bool, blank: bool, cut: bool) -> None:
        if dropped:
            return
        if turn is not None:  # in ascending order
            if self.first is None:
                self.first = turn
            self.distinct += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.counts[3] += 1
        repeat = (role, digest) in self.seen
        self.seen.add((role, digest))
        self.counts[0] += blank
        self.counts[1] += not blank and repeat
        self.counts[2] += not blank and not repeat and cut
        self.initials.append(initial)
        self.gone.append(blank or repeat)
        self.cut.append(not blank and not repeat and cut)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.counts, *cheapest_edits(self.initials, self.gone, self.cut)


def _in_order(rows: DataFrame, key: str, digest: Column, *before: str) -> DataFrame:
    """All rows of a conversation in one partition: by turn (nulls first), role and digest of the text."""
    return rows.repartition(key).sortWithinPartitions(key, *before, F.col("turn").asc_nulls_first(), "role", digest)


def repaired_texts(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    lead, j = 0, 0
    for edit in audit:
        if edit == "I":
            yield _ROLES[(j - lead) % 2], ""
            j += 1
            continue
        role, text = next(turns)
        if edit == "D":
            continue
        if j == 0 and edit == "K" and role[:1] == "s":
            lead = 1
        yield (role if edit == "K" else _ROLES[(j - lead) % 2]), text
        j += 1


def repair_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text) of the repaired conversations, numbered from 0, of (key, turn, role, text,
    dropped) rows as ``damage`` returns them; every conversation without any turn left is missing."""
    return _repaired(rows, key, digest=False)


def audit_conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation, the digest over ``role:text`` joined by line breaks.

    Conversations whose rows are all dropped have zeros, an empty audit and the digest of the empty
    string. Rows without a key are one conversation. Turns of one number are ordered by role and a
    digest of the text; rows that repeat are duplicates. An empty role is one that can't be kept. An
    empty table has no result rows.
    """
    return _repaired(rows, key, digest=True)


def _repaired(rows: DataFrame, key: str, digest: bool) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    audits = _audits(rows, key)
    heads = audits.select(
        key, F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.col("audit").alias("text"), F.array(*COUNTS).alias("counts"),
    )
    body = rows.filter(~F.col("dropped")).select(
        key, F.lit(1).alias("part"), "turn", "role", "text", F.lit(None).cast("array<bigint>").alias("counts")
    )
    hashed = heads.unionByName(body).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    ordered = _in_order(hashed, key, F.col("digest"), "part").select(key, "counts", "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            types[0] = batch.column(0).type
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, counts, audit, iterator over its repaired turns)."""
        source = stream(batches)
        for k, counts, _, audit in source:
            left = audit.count("D") + audit.count("K") + audit.count("R")
            own = ((role, text) for _, (_, _, role, text) in zip(range(left), source, strict=False))
            yield k, counts, audit, repaired_texts(audit, own)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for k, counts, audit, turns in conversations(batches):
            h = hashlib.sha256()
            for n, (role, text) in enumerate(turns):
                h.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            done.append((k, *counts, audit, h.hexdigest()))
            if len(done) == 10_000:
                yield _batch(done, names, types)
                done = []
        if done:
            yield _batch(done, names, types)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for k, _, _, turns in conversations(batches):
            for n, (role, text) in enumerate(turns):
                done.append((k, n, role, text))
                size += len(text) + 50
                if size > 1 << 22:
                    yield _batch(done, names, types)
                    done, size = [], 0
        if done:
            yield _batch(done, names, types)

    if digest:
        names = [key, *COUNTS, "audit", "repaired_sha256"]
        types = [None, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        counts = ", ".join(f"{c} long" for c in COUNTS)
        return ordered.mapInArrow(digests, f"`{key}` {kind}, {counts}, audit string, repaired_sha256 string")
    names, types = [key, "turn", "role", "text"], [None, pa.int64(), pa.string(), pa.string()]
    return ordered.mapInArrow(texts, f"`{key}` {kind}, turn long, role string, text string")


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
