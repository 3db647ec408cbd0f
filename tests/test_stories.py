import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_validate_clean import batch, event
from wirepulse.functions import text
from wirepulse.functions.embedding import hashed_words, model_embedder
from wirepulse.operators import similarity
from wirepulse.operators import stories as st
from wirepulse.operators.components import connected_components
from wirepulse.operators.similarity import _joined, block_count, similarity_links, similarity_summary, to_cells
from wirepulse.params import StoryParams
from wirepulse.plans.story_job import inline_event_ids, run_and_store, run_story_job
from wirepulse.sources.story_store import StoryStore

RUN = dt.datetime(2026, 7, 4, 12)


def vectors(spark, rows):
    unit = [np.array(v, float) / np.linalg.norm(v) for v in rows]
    return spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(unit)], "id bigint, vector array<double>"
    )


def groups(spark, rows, threshold, blocks=None):
    df = vectors(spark, rows)
    found = connected_components(df, similarity_links(df, threshold, blocks)).collect()
    out = {}
    for row in found:
        out.setdefault(row.component, []).append(row.id)
    return sorted((sorted(g) for g in out.values()), key=lambda g: (-len(g), g))


def test_cluster_cases(spark):
    assert groups(spark, [(1, 0), (1, 0), (0, 1)], 0.9) == [[0, 1], [2]]
    assert groups(spark, [(1, 0, 0), (1, 0.55, 0), (1, 1.2, 0)], 0.85) == [[0, 1, 2]]
    assert groups(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1)], 0.5) == [[0], [1], [2]]


@pytest.mark.parametrize("threshold", [0.0, 1.0, -0.2, 1.5])
def test_threshold_range(spark, threshold):
    with pytest.raises(ValueError):
        similarity_links(vectors(spark, [(1, 0)]), threshold)


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_blocks_agree_with_brute_force(spark, blocks):
    rng = np.random.default_rng(42)
    rows = rng.normal(size=(50, 8))
    unit = np.round((lambda m: m @ m.T)(rows / np.linalg.norm(rows, axis=1, keepdims=True)), 9)
    np.fill_diagonal(unit, -2)
    hits = unit >= 0.5
    label = np.arange(50)
    while True:
        new = np.array([min(label[i], *label[hits[i]], label[i]) for i in range(50)])
        if (new == label).all():
            break
        label = new
    want = {}
    for i, g in enumerate(label):
        want.setdefault(g, []).append(i)
    assert groups(spark, rows, 0.5, blocks) == sorted(want.values(), key=lambda g: (-len(g), g))
    got = {r.id: (r.partners, r.best_id) for r in similarity_summary(vectors(spark, rows), 0.5, blocks).collect()}
    assert got == {i: (hits[i].sum(), unit[i].argmax()) for i in range(50) if hits[i].any()}


def test_links_stay_linear_for_copies(spark):
    links = similarity_links(vectors(spark, [(1, 0)] * 60), 0.9, blocks=2)
    assert links.count() <= 60 * 3


def clustered(spark, clusters=12, each=40):
    """Tight clusters far from one another, and zero vectors."""
    rng = np.random.default_rng(1)
    centers = np.eye(16)[:clusters]
    rows = np.concatenate([c + rng.normal(scale=0.02, size=(each, 16)) for c in centers])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    data = [(i, v.tolist()) for i, v in enumerate(rows)] + [(9000 + i, [0.0] * 16) for i in range(3)]
    return rows, spark.createDataFrame(data, "id bigint, vector array<double>")


def test_far_blocks_are_never_compared(spark):
    """Same results with blocks around pivots; on clustered vectors most pairs of blocks are skipped."""
    rows, df = clustered(spark)
    one = sorted(map(tuple, similarity_summary(df, 0.9, 1).collect()))
    assert sorted(map(tuple, similarity_summary(df, 0.9, 24).collect())) == one
    assert len(one) == len(rows)
    cells, n = to_cells(df, 0.9, 24)
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    pairs = n * (n + 1) // 2
    assert n >= 12 and len(counts) < pairs / 3
    assert sum(counts.values()) < df.count() * n / 3  # rows moved, against each vector to each block
    links = similarity_links(df, 0.9, 24)
    found = {r.id: r.component for r in connected_components(df, links).collect()}
    assert all(found[i] == i // 40 * 40 for i in range(len(rows))) and found[9001] == 9001


def test_blocks_without_structure(spark):
    rng = np.random.default_rng(2)
    df = vectors(spark, rng.normal(size=(150, 4)))
    want = sorted(map(tuple, similarity_summary(df, 0.6, 1).collect()))
    for blocks in (2, 9, 40):
        assert sorted(map(tuple, similarity_summary(df, 0.6, blocks).collect())) == want
    zeros = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(5)], "id bigint, vector array<double>")
    assert similarity_summary(zeros, 0.5, 3).count() == 0


def chained(size=600, far=40):
    """A dense arc of vectors, each similar to the next ones, and vectors of small groups far from it."""
    rng = np.random.default_rng(4)
    at = rng.permutation(np.linspace(0, 2 * np.pi, size, endpoint=False))
    arc = np.stack([np.cos(at), np.sin(at)] + [np.zeros(size)] * far, axis=1)
    rest = np.repeat(np.eye(2 + far)[2:], 2, axis=0) + rng.normal(scale=0.01, size=(2 * far, 2 + far))
    return np.concatenate([arc, rest])


@pytest.mark.parametrize("blocks", [2, 12, 40])
def test_vectors_of_a_large_group_are_not_compared_in_all_blocks(spark, monkeypatch, blocks):
    """The result of a single cell, although few vectors visit other blocks."""
    moved = []
    plain = similarity.blocks_to_visit
    monkeypatch.setattr(similarity, "blocks_to_visit", lambda rows, *rest, **more: moved.append(rows.count()) or plain(rows, *rest, **more))
    monkeypatch.setattr(similarity, "VISITORS", 7)
    rows = chained()
    want = [list(range(600))] + [[i, i + 1] for i in range(600, 680, 2)]
    assert groups(spark, rows, 0.9, blocks) == want == groups(spark, rows, 0.9, 1)
    # A hub of a fortieth is too thin to chain along the arc.
    assert moved and (moved[0] <= 2 * len(rows) / 5 or blocks == 40)


@pytest.mark.parametrize("seed", range(4))
def test_two_rounds_of_links_lose_none(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(160, 5)) * rng.choice([1, 3], 5) + rng.choice([0, 1.5])
    monkeypatch.setattr(similarity, "VISITORS", 5)
    monkeypatch.setattr(similarity, "HUB", 6)
    for threshold in (0.85, 0.97):
        want = groups(spark, rows, threshold, 1)
        assert groups(spark, rows, threshold, 16) == want


def test_least_similarity_is_where_rounding_reaches_the_threshold():
    for threshold in (0.6, 0.4, 0.123456789, 0.9999):
        least = similarity._least(threshold)
        assert np.round(least, 9) >= threshold > np.round(np.nextafter(least, 0), 9)


def test_labels_of_joined_groups():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = rng.integers(1, 12, 2)
        label = np.arange(n + m)
        edges = []
        for start in range(0, n, 4):
            hits = rng.random((min(4, n - start), m)) < rng.choice([0.05, 0.2, 0.5])
            edges += [(start + r, n + c) for r, c in zip(*np.nonzero(hits), strict=True)]
            label = _joined(label, start, n, hits)
        want = np.arange(n + m)
        for _ in range(n + m):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        assert (label == want).all()


def test_block_count_grows_with_the_data():
    assert block_count(10) == 1
    assert 100 < block_count(10_000_000) < 200


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame(chain + hub, "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), *range(1000, 1100), 5000]], "id bigint")
    got = {r.id: r.component for r in connected_components(nodes, edges).collect()}
    assert len(got) == 302
    assert {got[i] for i in range(201)} == {0}
    assert {got[i] for i in range(1000, 1100)} == {1000} and got[5000] == 5000


@pytest.mark.parametrize("members, expected", [
    ([(30, 10), (20, 30), (10, 90)], ("rising", 50, 10)),
    ([(5, 10), (40, 70), (30, 110)], ("falling", 5, 70)),
    ([(10, 10), (10, 90)], ("steady", 10, 10)),
    ([(15, 5)], ("rising", 15, 0)),
    ([(15, 100)], ("falling", 0, 15)),
    ([(None, 10), (10, 10)], ("rising", 10, 0)),
    ([(10, 10), (500, 200)], ("rising", 10, 0)),
    ([(7, -30)], ("rising", 7, 0)),
])
def test_trend(spark, members, expected):
    rows = [event(i, num_articles=n, date_added=RUN - dt.timedelta(minutes=m)) for i, (n, m) in enumerate(members)]
    row = st.story_trend(batch(spark, rows).withColumn("story_id", F.lit(1)), RUN).first()
    assert (row.trend, row.articles_last_hour, row.articles_prev_hour) == expected


def titled(spark):
    minutes = lambda m: RUN - dt.timedelta(minutes=m)
    rows = [
        event(10, page_title="Mumbai floods worsen today", num_articles=5, source_url="u1", date_added=minutes(10), avg_tone=None, lat=19.0),
        event(11, page_title="Mumbai floods worsen today", num_articles=9, source_url="u2", date_added=minutes(70), avg_tone=-2.0, lat=18.0),
        event(12, page_title="floods worsen Mumbai", num_articles=9, source_url="u1", date_added=minutes(80), avg_tone=-4.0, lat=17.0),
        event(13, page_title="Unrelated story", num_articles=None, source_url=None, date_added=minutes(30)),
        event(14, page_title=None, date_added=minutes(30)),
        event(15, page_title="Too old story", date_added=RUN - dt.timedelta(hours=7)),
    ]
    return batch(spark, rows).withColumn("intensity", F.lit(0.5))


def test_story_job(spark):
    responses = spark.createDataFrame([(10, '"Floods hit Mumbai."\nmore')], "story_id bigint, response string")
    run = run_story_job(titled(spark), RUN, responses)
    rows = {r.story_id: r for r in run.stories.collect()}
    assert set(rows) == {10, 13}
    story = rows[10]
    assert (story.member_count, story.total_articles, story.avg_tone, story.lat) == (3, 23, -3.0, 18.0)
    assert story.source_urls == ["u1", "u2"] and story.trend == "falling"
    assert story.summary == 'Floods hit Mumbai."' and rows[13].summary == "Unrelated story"
    metrics = run.metrics.first()
    assert (metrics.events, metrics.clusters, metrics.multi_member_clusters, metrics.labels) == (4, 2, 1, 1)
    docs = {r.id: r for r in run.documents.collect()}
    assert docs[set_digest([10, 11, 12])].title == "Mumbai floods worsen today"
    assert docs[set_digest([13])].source_url == ""


def set_digest(ids):
    """The document id of a story, by its definition."""
    quarters = [[int(hashlib.md5(str(i).encode()).hexdigest()[8 * q : 8 * q + 8], 16) for q in range(4)] for i in ids]
    return hashlib.sha1(",".join(map(str, [len(ids), *map(sum, zip(*quarters))])).encode()).hexdigest()


def test_one_rule_for_small_and_large_stories(spark):
    """Story 1 has a few members, story 2 more than the array limit that once changed the rule."""
    sizes = {1: 3, 2: 100_001}
    members = spark.range(sizes[2]).selectExpr("2 as story_id", "id as global_event_id").union(
        spark.range(sizes[1]).selectExpr("1", "id")
    )
    ids = st.story_event_ids(members)
    assert ids.count() == sum(sizes.values())
    got = {r.story_id: r.doc_id for r in st.document_ids(ids.repartition(7)).collect()}
    assert got == {s: set_digest(range(n)) for s, n in sizes.items()}
    shown = inline_event_ids(spark.createDataFrame([(1,), (2,)], "story_id bigint"), ids)
    assert {r.story_id: len(r.event_ids) for r in shown.collect()} == sizes


def test_label_budget_counts_usable_labels_only(spark):
    stories = spark.range(1, 41).select(
        F.col("id").alias("story_id"), (F.lit(100) - F.col("id")).alias("member_count"), F.lit("t").alias("rep_title")
    )
    responses = stories.select("story_id", F.when(F.col("story_id") % 2 == 0, "label").alias("response"))
    labelled = st.label_stories(stories, responses, StoryParams(max_labels=5))
    got = sorted(r.story_id for r in labelled.filter("label is not null").collect())
    assert got == [2, 4, 6, 8, 10]


def test_prompt_and_label_text(spark):
    titles = ["Same story"] * 3 + [" Same story ", "", "  "] + [f"t{i}" for i in range(20)]
    row = spark.createDataFrame([(titles,)], "titles array<string>")
    prompt = row.select(text.label_prompt(F.col("titles")).alias("p")).first().p
    assert prompt.count("\n- ") == 8 and prompt.count("Same story") == 1
    labels = {
        '"Mumbai floods worsen."': 'Mumbai floods worsen', "'One'": "One", "First line\nSecond": "First line",
        "  \n ": None, "Ends...": "Ends", "A\r\nB": "A",
    }
    df = spark.createDataFrame([(k,) for k in labels], "r string")
    got = {r.r: r.l for r in df.select("r", text.clean_label(F.col("r")).alias("l")).collect()}
    assert got == labels


def test_display_title(spark):
    df = spark.createDataFrame(
        [("T", "A", "B", 1), ("", "A", "B", 2), (None, None, "B", 3), (None, "", None, 4)],
        "t string, a string, b string, i bigint",
    )
    got = [r[0] for r in df.select(text.display_title(*map(F.col, "tabi"))).collect()]
    assert got == ["T", "A – B", "B", "Event 4"]


def bag(words):
    vec = np.zeros(64)
    for word in words.lower().split():
        vec[int(hashlib.md5(word.encode()).hexdigest(), 16) % 64] += 1
    norm = np.linalg.norm(vec)
    return vec / norm if norm else vec


def test_hashed_words_equal_the_definition(spark):
    texts = ["Mumbai floods worsen", "  Été  à\tParis ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hashed_words(F.col("t"))).collect()
    for row, value in zip(rows, texts):
        assert np.allclose(row[0], bag(value))


def test_model_embedder_normalizes(spark):
    def load():
        return lambda values: np.array([[len(v), 1.0] for v in values])

    df = spark.createDataFrame([("abc",), (None,)], "t string")
    got = [r[0] for r in df.select(model_embedder(load)(F.col("t"))).collect()]
    assert np.allclose(got[0], np.array([3, 1]) / np.sqrt(10)) and np.allclose(got[1], [0, 1])


def test_stored_runs(spark, tmp_path):
    """Runs are folders: the newest comes from their names, readers open only their own, old ones go."""
    store = StoryStore(spark, str(tmp_path / "runs"))
    assert store.latest().count() == 0 and store.keys() == []
    rows = [event(i, date_added=RUN - dt.timedelta(hours=i), page_title=f"title {i % 3}") for i in range(4)]
    scored = batch(spark, rows).withColumn("intensity", F.lit(0.5))
    early = RUN - dt.timedelta(hours=2)
    assert run_and_store(scored, early, store) == [] and run_and_store(scored, RUN, store) == []
    assert store.keys() == ["20260704100000", "20260704120000"]
    assert {r.run_at for r in store.latest().collect()} == {RUN} and {r.run_at for r in store.latest(until=early).collect()} == {early}
    assert sum(r.member_count for r in store.latest(until=early).collect()) == 2  # nothing newer was known
    for _ in range(2):  # a run that is stored again replaces itself
        run_and_store(scored, RUN, store)
    assert store.latest_members().count() == 4 and store.stories().count() == 5
    plan = store.latest()._jdf.queryExecution().executedPlan().toString()
    assert "run_key" in plan.split("PartitionFilters: [")[1].split("]")[0]
    late = RUN + dt.timedelta(hours=71)
    assert run_and_store(scored, late, store) == ["20260704100000"]
    # A run without stories leaves no folder, as it leaves no row.
    assert store.keys() == ["20260704120000"] and not list((tmp_path / "runs").rglob("*20260704100000*"))
