"""Parameters of the scoring formula, the story job and retention."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class ScoreParams:
    """Weights and shape of the attention score.

    Caps are fixed rather than taken from the batch, so scores of different runs compare.
    """

    w_articles: float = 0.4
    w_sources: float = 0.3
    w_recency: float = 0.3
    articles_cap: int = 100
    sources_cap: int = 25
    half_life_hours: float = 6.0

    @classmethod
    def from_env(cls) -> "ScoreParams":
        """Defaults overridden by ``INTENSITY_*`` variables of the driver process."""
        env, base = os.environ, cls()
        return cls(
            w_articles=float(env.get("INTENSITY_W_ARTICLES", base.w_articles)),
            w_sources=float(env.get("INTENSITY_W_SOURCES", base.w_sources)),
            w_recency=float(env.get("INTENSITY_W_RECENCY", base.w_recency)),
            articles_cap=int(env.get("INTENSITY_ARTICLES_CAP", base.articles_cap)),
            sources_cap=int(env.get("INTENSITY_SOURCES_CAP", base.sources_cap)),
            half_life_hours=float(env.get("INTENSITY_HALF_LIFE_HOURS", base.half_life_hours)),
        )


@dataclass(frozen=True)
class StoryParams:
    window_hours: int | None = 6  # None: all time
    threshold: float = 0.6
    max_labels: int = 25
    retention_hours: int = 72
    max_urls: int = 5
    max_prompt_titles: int = 8


@dataclass(frozen=True)
class RetentionParams:
    retention_days: int = 90
    cell_degrees: int = 2
