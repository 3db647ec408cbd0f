"""Attention score: saturating counts plus exponential freshness."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.params import ScoreParams


def as_of_column(as_of: datetime | str | Column) -> Column:
    """A reference time as a column: a datetime, an ISO text, or an expression such as a scalar
    subquery."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def latest(df: DataFrame, column: str = "date_added") -> Column:
    """``max(column)`` of ``df`` as a scalar subquery, the deterministic stand-in for "now"."""
    return df.agg(F.max(column)).scalar()


def normalized_count(value: Column, cap: float) -> Column:
    """``log1p(value) / log1p(cap)`` clipped to [0, 1]; NULL and negatives count as 0."""
    if cap <= 0:
        raise ValueError("cap must be positive")
    floor_zero = F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))
    return F.least(F.lit(1.0), F.log1p(floor_zero) / F.lit(math.log1p(cap)))


def age_hours(event_time: Column, reference: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", event_time, reference)
    return F.greatest(F.lit(0.0), micros / F.lit(3.6e9))


def recency_decay(event_time: Column, reference: Column, half_life_hours: float) -> Column:
    """1.0 at the reference time (or later), 0.5 one half-life before it."""
    if half_life_hours <= 0:
        raise ValueError("half_life_hours must be positive")
    return F.exp(F.lit(-math.log(2) / half_life_hours) * age_hours(event_time, reference))


def attention(
    params: ScoreParams = ScoreParams(), articles: str = "num_articles", sources: str = "num_sources"
) -> Column:
    """The part of the score that no reference time changes."""
    return F.lit(params.w_articles) * normalized_count(F.col(articles), params.articles_cap) + F.lit(
        params.w_sources
    ) * normalized_count(F.col(sources), params.sources_cap)


def intensity(
    as_of: datetime | str | Column,
    params: ScoreParams = ScoreParams(),
    articles: str = "num_articles",
    sources: str = "num_sources",
    event_time: str = "date_added",
) -> Column:
    """Weighted score in [0, 1] relative to ``as_of``, whichever instant that is."""
    return attention(params, articles, sources) + freshness(as_of, params, event_time)


def freshness(
    as_of: datetime | str | Column, params: ScoreParams = ScoreParams(), event_time: str = "date_added"
) -> Column:
    """The part of the score that fades."""
    decay = recency_decay(F.col(event_time), as_of_column(as_of), params.half_life_hours)
    return F.lit(params.w_recency) * decay
