"""Tables that the pipeline stores and the queries read: scored events and story members.

Each is built once per session and data folder, below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from wirepulse.catalog import inputs
from wirepulse.operators.clean import clean, score, write_scored
from wirepulse.params import StoryParams
from wirepulse.plans.story_job import cluster_events, run_and_store
from wirepulse.schemas import SCORED_SCHEMA
from wirepulse.sources.folders import Folder
from wirepulse.sources.story_store import StoryStore
from wirepulse.session import SHUFFLE_CLEANUP, fresh_path, settings

# Stories of the whole table, whatever time it spans.
WHOLE_TABLE = StoryParams(window_hours=None)
# Runs of the story job, hours before the newest event; the first is past its retention at the last.
RUN_HOURS = (80, 24, 0)
RUN_PARAMS = StoryParams(window_hours=24)

_PATHS: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        path = fresh_path(spark, name)
        with settings(spark, SHUFFLE_CLEANUP):
            write(path)
        _PATHS[key] = path
    return _PATHS[key]


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table of the whole event table."""

    def write(path: str) -> None:
        # The cleaned rows are written first: what was shuffled for them is gone when they are clustered.
        cleaned = clean(inputs.raw_events(spark, sf_dir))
        cleaned.write.parquet(f"{path}_cleaned")
        rows = spark.read.schema(cleaned.schema).parquet(f"{path}_cleaned")
        write_scored(score(rows, inputs.newest(spark, sf_dir)), path)
        folder, name = path.rsplit("/", 1)
        Folder(spark, folder).delete(f"{name}_cleaned")

    path = stored(spark, sf_dir, "events_scored", write)
    return spark.read.schema(SCORED_SCHEMA).parquet(path)


def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members (story_id + event columns) of the stories over the whole table."""

    def write(path: str) -> None:
        events = scored_events(spark, sf_dir)
        cluster_events(events, inputs.newest(spark, sf_dir), params=WHOLE_TABLE).write.parquet(path)

    path = stored(spark, sf_dir, "story_members", write)
    return spark.read.schema(SCORED_SCHEMA + ", story_id bigint").parquet(path)


def story_store(spark: SparkSession, sf_dir: str) -> StoryStore:
    """The stored runs of the story job, one after another as a schedule would make them."""

    def write(path: str) -> None:
        events = scored_events(spark, sf_dir)
        newest = spark.range(1).select(inputs.newest(spark, sf_dir)).first()[0]
        for hours in RUN_HOURS:
            run_and_store(events, newest - timedelta(hours=hours), StoryStore(spark, path), params=RUN_PARAMS)

    return StoryStore(spark, stored(spark, sf_dir, "story_runs", write))
