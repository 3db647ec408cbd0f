"""The story job: recent titled events -> stories, labels, index documents, run metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.embedding import hashed_words
from wirepulse.functions.scoring import as_of_column
from wirepulse.operators import stories as st
from wirepulse.operators.events import time_filter
from wirepulse.params import StoryParams
from wirepulse.sources.story_store import StoryStore


@dataclass(frozen=True)
class StoryRun:
    """Results of one run; all but the checkpointed members are lazy."""

    members: DataFrame
    stories: DataFrame
    event_ids: DataFrame
    documents: DataFrame
    metrics: DataFrame


def cluster_events(
    scored: DataFrame,
    run_at,
    embed: Callable[[Column], Column] = hashed_words,
    params: StoryParams = StoryParams(),
) -> DataFrame:
    """Member rows (story_id + event columns) of the events in the story window."""
    events = st.story_input(scored, run_at, params.window_hours)
    titles = st.title_components(st.title_nodes(events), embed, params.threshold)
    return st.story_members(events, titles)


def run_story_job(
    scored: DataFrame,
    run_at,
    responses: DataFrame | None = None,
    embed: Callable[[Column], Column] = hashed_words,
    params: StoryParams = StoryParams(),
) -> StoryRun:
    """All outputs of a run. ``responses`` (story_id, response) are generated labels, if any."""
    # Read by every output below; checkpointed so that the clustering runs once.
    members = cluster_events(scored, run_at, embed, params).checkpoint()
    if responses is None:
        responses = scored.sparkSession.createDataFrame([], "story_id bigint, response string")
    plain = st.aggregate_stories(members, run_at, params)
    stories = st.label_stories(plain, responses, params).withColumn(
        "run_at", as_of_column(run_at)
    )
    event_ids = st.story_event_ids(members)
    documents = st.story_documents(stories, st.document_ids(event_ids))
    return StoryRun(members, stories, event_ids, documents, st.story_metrics(stories))


def inline_event_ids(stories: DataFrame, event_ids: DataFrame) -> DataFrame:
    """Stories with ``event_ids`` as one sorted array, for a result already cut to an API limit: only
    the ids of these stories are gathered, and all of them."""
    shown = event_ids.join(stories.select("story_id"), "story_id", "left_semi")
    lists = shown.groupBy("story_id").agg(F.array_sort(F.collect_list("global_event_id")).alias("event_ids"))
    return stories.join(lists, "story_id", "left")


def run_and_store(
    scored: DataFrame,
    run_at: datetime,
    store: StoryStore,
    responses: DataFrame | None = None,
    embed: Callable[[Column], Column] = hashed_words,
    params: StoryParams = StoryParams(),
) -> list[str]:
    """One cycle of the job over the events known at ``run_at``: its stories and their members are added
    to the store, runs past their retention go. Returns the keys of those."""
    known = time_filter(scored, end=run_at)
    run = run_story_job(known, run_at, responses, embed, params)
    return store.append(run_at, run.stories, run.event_ids, params)
