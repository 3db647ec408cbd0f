"""Stories: events grouped by similar titles, their aggregates, labels and index documents.

Member rows are ``(story_id, <event columns>, intensity)``; a story's id is its smallest event id.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.scoring import as_of_column
from wirepulse.functions.text import clean_label, document_text, iso_utc, label_prompt, strip
from wirepulse.operators.components import connected_components
from wirepulse.operators.events import time_filter
from wirepulse.operators.ranking import top_k_per_group
from wirepulse.operators.similarity import similarity_links
from wirepulse.params import StoryParams
from wirepulse.session import shared_dir

Instant = datetime | str | Column


def story_input(scored: DataFrame, run_at: Instant, window_hours: int | None = 6) -> DataFrame:
    """Titled events of the last ``window_hours``, or of all time; there is no upper bound."""
    titled = scored.filter(F.col("page_title").isNotNull())
    if window_hours is None:
        return titled
    return time_filter(titled, as_of_column(run_at) - F.make_dt_interval(hours=F.lit(window_hours)))


def title_nodes(events: DataFrame) -> DataFrame:
    """(id, page_title): distinct titles under their smallest event id.

    Events with the same title always belong together, so copies collapse here, before any
    vector is built, however many rows one title holds.
    """
    return events.groupBy("page_title").agg(F.min("global_event_id").alias("id"))


def title_components(
    nodes: DataFrame, embed, threshold: float = 0.6, blocks: int | None = None
) -> DataFrame:
    """(page_title, story_id) by transitive title similarity; ``embed`` maps text to unit vectors.

    The distinct titles are checkpointed once, since they are counted, compared and joined.
    """
    shared_dir(nodes.sparkSession)
    nodes = nodes.checkpoint()
    vectors = nodes.select("id", embed(F.col("page_title")).alias("vector"))
    components = connected_components(nodes, similarity_links(vectors, threshold, blocks))
    return nodes.join(components, "id").select("page_title", F.col("component").alias("story_id"))


def story_members(events: DataFrame, titles: DataFrame) -> DataFrame:
    """Events with their story; a title with very many events is split by the skew join."""
    return events.join(titles, "page_title")


def _articles() -> Column:
    return F.coalesce("num_articles", F.lit(0)).cast("bigint")


def trend_columns(run_at: Instant) -> list[Column]:
    """Articles of the last hour (no upper bound) and of the hour before it."""
    now = as_of_column(run_at)
    last = now - F.make_dt_interval(hours=F.lit(1))
    prev = now - F.make_dt_interval(hours=F.lit(2))
    added = F.col("date_added")
    return [
        F.sum(F.when(added >= last, _articles()).otherwise(0)).alias("articles_last_hour"),
        F.sum(F.when((added >= prev) & (added < last), _articles()).otherwise(0)).alias(
            "articles_prev_hour"
        ),
    ]


def trend_label(last: Column, prev: Column) -> Column:
    return (
        F.when(last > prev * 1.2, "rising").when(last < prev * 0.8, "falling").otherwise("steady")
    )


def story_trend(members: DataFrame, run_at: Instant, *keys: str) -> DataFrame:
    sums = members.groupBy(*(keys or ("story_id",))).agg(*trend_columns(run_at))
    return sums.withColumn(
        "trend", trend_label(F.col("articles_last_hour"), F.col("articles_prev_hour"))
    )


def first_urls(members: DataFrame, limit: int = 5, keys: tuple[str, ...] = ("story_id",)) -> DataFrame:
    """(keys, source_urls): first distinct non-empty URLs in member order.

    One row per (story, URL) is left before ranking, and only ``limit`` rows are collected.
    """
    urls = (
        members.filter(F.coalesce("source_url", F.lit("")) != "")
        .groupBy(*keys, "source_url")
        .agg(F.min("global_event_id").alias("_first"))
    )
    top = top_k_per_group(
        urls, list(keys), [F.asc("_first"), F.asc("source_url")], limit, ["source_url"]
    )
    pairs = F.array_sort(F.collect_list(F.struct("_first", "source_url")))
    return top.groupBy(*keys).agg(F.transform(pairs, lambda p: p["source_url"]).alias("source_urls"))


def aggregate_stories(
    members: DataFrame,
    run_at: Instant | None,
    params: StoryParams = StoryParams(),
    keys: tuple[str, ...] = ("story_id",),
) -> DataFrame:
    """One row per story: representative, counts, sums, trend, time span and URLs.

    Everything but the URLs is one map-side combined aggregation, so a story holding a third of
    the rows costs no more than others. The member ids are ``story_event_ids``. With
    ``run_at=None`` the trend is relative to a ``run_at`` key column.
    """
    now = F.col("run_at") if run_at is None else run_at
    weight = F.struct(_articles(), "intensity", -F.col("global_event_id"))
    representative = F.struct(
        "global_event_id", "page_title", "lat", "lon", "source_url",
        F.col("action_geo_full_name").alias("location"),
        F.col("action_geo_country_code").alias("country_code"),
    )
    sums = members.groupBy(*keys).agg(
        F.max_by(representative, weight).alias("rep"),
        F.count("*").alias("member_count"),
        F.sum(_articles()).alias("total_articles"),
        F.sum(F.coalesce("num_sources", F.lit(0)).cast("bigint")).alias("total_sources"),
        F.max("intensity").alias("intensity"),
        F.avg("avg_tone").alias("avg_tone"),
        F.min("date_added").alias("earliest"),
        F.max("date_added").alias("latest"),
        *trend_columns(now),
    )
    urls = first_urls(members, params.max_urls, keys)
    return sums.join(urls, list(keys), "left").select(
        *keys,
        F.col("rep.page_title").alias("rep_title"),
        F.col("rep.source_url").alias("rep_url"),
        F.col("rep.lat").alias("lat"),
        F.col("rep.lon").alias("lon"),
        "member_count", "total_articles", "total_sources", "intensity", "avg_tone",
        trend_label(F.col("articles_last_hour"), F.col("articles_prev_hour")).alias("trend"),
        "articles_last_hour", "articles_prev_hour",
        F.coalesce("source_urls", F.array().cast("array<string>")).alias("source_urls"),
        F.col("rep.location").alias("location"),
        F.col("rep.country_code").alias("country_code"),
        "earliest", "latest",
    )


def story_event_ids(members: DataFrame) -> DataFrame:
    """(story_id, global_event_id): one row per member, whatever the size of the story."""
    return members.select("story_id", "global_event_id").distinct()


def document_ids(event_ids: DataFrame) -> DataFrame:
    """(story_id, doc_id): a digest of the set of member ids, the same rule for every size.

    It is the sha1 of the number of ids and of four sums, of the 32-bit quarters of each id's md5, so
    a task holds five numbers per story and parts combine in any order. It differs from a digest of
    the listed ids.
    """
    quarter = lambda i: F.conv(
        F.substring(F.md5(F.col("global_event_id").cast("string").cast("binary")), 8 * i + 1, 8), 16, 10
    ).cast("bigint")
    sums = event_ids.groupBy("story_id").agg(
        F.count("*").alias("n"), *[F.sum(quarter(i)).alias(f"q{i}") for i in range(4)]
    )
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in ("n", "q0", "q1", "q2", "q3")])
    return sums.select("story_id", F.sha1(text).alias("doc_id"))


def prompt_titles(members: DataFrame, limit: int = 8) -> DataFrame:
    """(story_id, titles): first distinct titles in member order, for stories of two or more."""
    sizes = members.groupBy("story_id").agg(F.count("*").alias("n")).filter("n >= 2")
    titles = (
        members.select("story_id", "global_event_id", strip(F.col("page_title")).alias("title"))
        .filter(F.col("title") != "")
        .groupBy("story_id", "title")
        .agg(F.min("global_event_id").alias("_first"))
    )
    top = top_k_per_group(
        titles, ["story_id"], [F.asc("_first"), F.asc("title")], limit, ["title"]
    )
    pairs = F.array_sort(F.collect_list(F.struct("_first", "title")))
    lists = top.groupBy("story_id").agg(F.transform(pairs, lambda p: p["title"]).alias("titles"))
    return lists.join(sizes.select("story_id"), "story_id", "left_semi")


def label_prompts(members: DataFrame, params: StoryParams = StoryParams()) -> DataFrame:
    """(story_id, prompt) to be answered by a text generator outside this library."""
    titles = prompt_titles(members, params.max_prompt_titles)
    return titles.select("story_id", label_prompt(F.col("titles"), params.max_prompt_titles).alias("prompt"))


def label_stories(
    stories: DataFrame, responses: DataFrame, params: StoryParams = StoryParams()
) -> DataFrame:
    """Add ``label`` and ``summary``.

    ``responses`` has (story_id, response). Stories of two or more members are labelled largest
    first until ``max_labels`` usable labels are spent; all others show the representative's
    title.
    """
    usable = (
        stories.filter("member_count >= 2")
        .join(responses.withColumn("label", clean_label(F.col("response"))), "story_id")
        .filter(F.col("label").isNotNull())
        .orderBy(F.desc("member_count"), "story_id")
        .limit(params.max_labels)
        .select("story_id", "label")
    )
    labelled = stories.join(usable, "story_id", "left")
    return labelled.withColumn("summary", F.coalesce("label", "rep_title"))


def story_documents(stories: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Index entries of labelled stories: id, document text and metadata without NULLs."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return stories.join(doc_ids, "story_id").select(
        F.col("doc_id").alias("id"),
        document_text(F.col("rep_title"), F.col("summary")).alias("document"),
        blank("rep_title").alias("title"),
        blank("summary").alias("summary"),
        blank("rep_url").alias("source_url"),
        blank("country_code").alias("country_code"),
        iso_utc(F.col("latest")).alias("date_added"),
    )


def story_metrics(stories: DataFrame) -> DataFrame:
    """One row about a run: events, stories, multi-member stories, labels, dedup ratio."""
    totals = stories.agg(
        F.coalesce(F.sum("member_count"), F.lit(0)).alias("events"),
        F.count("*").alias("clusters"),
        F.count_if(F.col("member_count") > 1).alias("multi_member_clusters"),
        F.count("label").alias("labels"),
    )
    ratio = F.when(F.col("events") > 0, F.round(F.col("clusters") / F.col("events"), 3))
    return totals.withColumn("dedup_ratio", ratio)
