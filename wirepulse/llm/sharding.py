"""Equal shards by histogram sort.

Rows are ordered by (hash of the text, row key), so equal texts lie side by side. The splitters
between shards are found by counting: each round counts the exact bytes and rows below a few hundred
candidate boundaries in every partition and narrows the interval around each ideal boundary, until
the splitters are within the tolerance or no key lies between the probes. Only these sums reach the
driver. The rows then move once, to the bin of their splitter interval.

Several bins make up a shard, so that a task holds a bin and not a shard; the counts of the last
round are the number of rows before each bin, and a row's slot is that number plus its rank in the
bin.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.llm.common import stored

# Candidate boundaries inside each open interval and round.
PROBES = 15
_SHIFT = 1 << 63
_COUNTS = "bin bigint, size bigint, rows bigint, h0 bigint, l0 bigint, h1 bigint, l1 bigint"


def _key(high: int, low: int) -> int:
    """Both halves as one number of 128 bits, in the order of the pair."""
    return (high + _SHIFT) << 64 | (low + _SHIFT)


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    high = [(k >> 64) - _SHIFT for k in keys]
    low = [(k & ((1 << 64) - 1)) - _SHIFT for k in keys]
    return np.array(high, np.int64), np.array(low, np.int64)


def _below(high: np.ndarray, low: np.ndarray, probes: list[int]) -> np.ndarray:
    """For each row, the number of probes that are not above its key."""
    ph, pl = _halves(probes)
    first = np.searchsorted(ph, high, "left")
    out = np.searchsorted(ph, high, "right")
    for i in np.flatnonzero(first < out):  # equal hash: the low half decides
        out[i] = first[i] + np.searchsorted(pl[first[i] : out[i]], low[i], "right")
    return out


def _counts(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """(bytes, rows, smallest key, largest key) of each non-empty interval between probes, in
    order."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            high, low = part["_high"].to_numpy(), part["_low"].to_numpy()
            at = _below(high, low, probes)
            order = np.lexsort((low, high, at))
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            last = np.append(first[1:], len(order)) - 1
            yield pd.DataFrame(
                {
                    "bin": at[order[first]],
                    "size": np.add.reduceat(part["_size"].to_numpy()[order], first) if len(order) else [],
                    "rows": last - first + 1,
                    "h0": high[order[first]], "l0": low[order[first]],
                    "h1": high[order[last]], "l1": low[order[last]],
                }
            )

    found = (
        keys.select("_high", "_low", "_size")
        .mapInPandas(count, _COUNTS)
        .groupBy("bin")
        .agg(F.sum("size"), F.sum("rows"), F.min(F.struct("h0", "l0")), F.max(F.struct("h1", "l1")))
        .collect()
    )
    return [(s, r, _key(*lo), _key(*hi)) for _, s, r, lo, hi in sorted(found)]


def splitters(keys: DataFrame, parts: int, tolerance: int) -> tuple[list[int], list[int], int]:
    """(splitter keys, rows below each, rounds) that cut all bytes into ``parts`` equal parts.

    ``keys`` has ``_high``, ``_low`` and ``_size``. A splitter is settled when the bytes below it are
    within ``tolerance`` of its ideal, or when its interval holds a single key. Every round cuts the
    span of the keys in an open interval into 16, so rounds end after 32 at the latest.
    """
    probes: set[int] = {(j + 1 << 128) // (8 * parts) for j in range(8 * parts - 1)}
    best: dict[int, tuple[int, int, int]] = {}
    open_ = range(parts - 1)
    rounds = 0
    while open_:
        rounds += 1
        found = _counts(keys, sorted(probes))
        total = sum(s for s, _, _, _ in found)
        below = list(accumulate(found, lambda at, x: (at[0] + x[0], at[1] + x[1]), initial=(0, 0)))
        probes, still = set(), []
        for k in open_:
            ideal = total * (k + 1) // parts
            i = bisect_right(below, ideal, key=itemgetter(0)) - 1
            if i == len(found):  # nothing lies above the ideal
                best[k] = (0, (1 << 128) - 1, below[-1][1])
                continue
            (size, rows), (s, r, low, high) = below[i], found[i]
            ends = [(ideal - size, low, rows), (size + s - ideal, high + 1, rows + r)]
            best[k] = min([*ends, *([best[k]] if k in best else [])])
            if best[k][0] > tolerance and high > low:
                still.append(k)
                span = high - low
                probes |= {low, high + 1, *(low + 1 + span * j // (PROBES + 1) for j in range(PROBES + 1))}
        open_ = still
    cuts = sorted((b[1], b[2]) for b in best.values())
    return [c for c, _ in cuts], [r for _, r in cuts], rounds


def histogram_shards(
    df: DataFrame,
    shards: int,
    size: Column,
    text: Column,
    key: str = "doc_id",
    bins: int = 1,
    tolerance: int = 256,
) -> DataFrame:
    """``df`` with shard and slot (gapless from 0 in each shard), equal bytes to within ``tolerance``
    or the largest row at each boundary; existing columns of these names are replaced.

    ``key`` is a whole number that tells rows apart; rows that repeat it are ordered arbitrarily but
    alike. ``bins`` splits every shard into so many parts for the exchange. Null texts hash as empty;
    a null key counts as the smallest. With fewer rows than shards some shards stay empty.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    keyed = df.select(
        *kept,
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_high"),
        F.coalesce(F.col(key).cast("long"), F.lit(-_SHIFT)).alias("_low"),
        size.cast("long").alias("_size"),
    )
    keyed = stored(keyed, "shard-keys")
    cuts, before, _ = splitters(keyed, shards * bins, tolerance)
    starts = [0, *before]
    starts += [starts[-1]] * (shards * bins - len(starts))

    @F.pandas_udf("long")
    def bin_of(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(_below(high.to_numpy(), low.to_numpy(), cuts))

    # Rows of the shard before each bin, known from the counts.
    bases = F.array(*[F.lit(starts[b] - starts[b // bins * bins]).cast("long") for b in range(shards * bins)])
    binned = keyed.withColumn("_bin", bin_of("_high", "_low"))
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_high", "_low")) - 1
    return binned.withColumns(
        {"shard": F.floor(F.col("_bin") / bins).cast("int"), "slot": F.get(bases, F.col("_bin").cast("int")) + rank}
    ).select(*kept, "shard", "slot")
