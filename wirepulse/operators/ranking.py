"""Latest-per-key and top-k that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order``.

    The ``= 1`` filter becomes a map-side group limit: each task sends at most one row per key
    into the shuffle, however hot the key is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def top_k_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    limit: int | Column,
    spread_by: list[str],
    salts: int = SALTS,
    rank: str | None = None,
    most: int | None = None,
) -> DataFrame:
    """Top ``limit`` rows per group in two steps, so no task ranks a whole hot group.

    Step one ranks within (group, salt) with the salt taken from ``spread_by``; step two ranks
    the at most ``salts * limit`` survivors of a group. ``order`` must be total. ``rank`` names
    an output column for the final position. With a limit that is a column, ``most`` is its largest
    value: Spark then cuts groups to that many rows before the exchange.
    """
    bound = F.lit(limit) if isinstance(limit, int) else limit
    name = rank or "_rank"
    within = lambda c: (F.col(c) <= bound) if most is None else (F.col(c) <= most) & (F.col(c) <= bound)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    partial = (
        salted.withColumn("_inner", F.row_number().over(inner))
        .filter(within("_inner"))
        .drop("_inner", "_salt")
    )
    final = partial.withColumn(name, F.row_number().over(outer)).filter(within(name))
    return final if rank else final.drop(name)
