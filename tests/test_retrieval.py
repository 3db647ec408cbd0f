import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirepulse.functions.embedding import hashed_words
from wirepulse.functions.geo import detect_country
from wirepulse.functions.text import document_text
from wirepulse.operators import retrieval
from wirepulse.operators.similarity import lay_out

ARTICLES = [
    ("1", "Mumbai floods worsen", "Red alert issued", "https://a.example/1", "IN"),
    ("2", "EU summit reaches trade deal", "Leaders agree on tariffs", "https://a.example/2", "BE"),
    ("3", "Tokyo stock market rallies", "Nikkei hits record high", "", "JA"),
    ("4", "Wildfire spreads near Athens", "Evacuations ordered", "https://a.example/4", "GR"),
    ("5", "Cricket World Cup final set", "India to face Australia", "https://a.example/5", "IN"),
]


@pytest.fixture(scope="module")
def index(spark):
    schema = "id string, title string, summary string, source_url string, country_code string"
    df = spark.createDataFrame(ARTICLES, schema).withColumn("date_added", F.lit("2026-07-04T12:00:00+00:00"))
    return retrieval.index_articles(
        df.withColumn("document", document_text(F.col("title"), F.col("summary"))), hashed_words
    )


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "question_id bigint, question string")


def test_most_similar_first(spark, index):
    asked = retrieval.embed_questions(ask(spark, "Mumbai floods worsen Red alert issued"), hashed_words)
    hits = retrieval.nearest_entries(asked, index, k=3).orderBy("rank").collect()
    assert len(hits) == 3 and hits[0].id == "1" and hits[0].similarity == pytest.approx(1.0)


def test_scope_and_fallback(spark, index):
    asked = retrieval.embed_questions(
        ask(spark, "What is happening in India?", "What is happening in Zimbabwe?", "anything"), hashed_words
    )
    assert [r.country for r in asked.orderBy("question_id").collect()] == ["IN", "ZI", None]
    hits = retrieval.nearest_with_fallback(asked, index).collect()
    by_question = {q: {h.id for h in hits if h.question_id == q} for q in range(3)}
    assert by_question == {0: {"1", "5"}, 1: set("12345"), 2: set("12345")}


def test_far_blocks_are_skipped(spark):
    """Clustered unit vectors: the same hits as a full search, ties and zero vectors included, from few
    of the blocks."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    entries = np.repeat(centers, 30, axis=0) + rng.normal(scale=0.05, size=(360, 16))
    entries = np.concatenate([entries, entries[:40], np.zeros((3, 16))])
    asked = np.concatenate([entries[::9] + rng.normal(scale=0.01, size=entries[::9].shape), np.zeros((1, 16)), rng.normal(size=(3, 16))])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    e = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(unit(entries))], "id string, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(asked))], "question_id bigint, vector array<double>")
    full = sorted(map(tuple, retrieval._search(q, e, None, 5, 4096, 16384).collect()))
    pruned = retrieval._search_all(q, e, 5, 16, 20).select("question_id", "id", "similarity", "scoped", "rank")
    assert sorted(map(tuple, pruned.collect())) == [tuple(r) for r in sorted(full)] and len(full) == 5 * len(asked)
    placed, layout = lay_out(e, 22, "id", "embedding")
    home = retrieval._home(q, layout)
    first = retrieval._search(home, placed, "block", 5, 4096, 16384)
    looked = retrieval.visits(home, layout, 5, first).count() + len(asked)
    assert layout.unit and looked < len(asked) * layout.count / 2


@pytest.mark.parametrize("question_block, entry_block", [(4096, 16384), (3, 7)])
def test_blocks_agree_with_brute_force(spark, question_block, entry_block):
    rng = np.random.default_rng(1)
    entries = np.round(rng.normal(size=(40, 4)), 1)
    asked = np.round(rng.normal(size=(9, 4)), 1)
    e = spark.createDataFrame([(f"{i:03d}", v.tolist(), "AB"[i % 2]) for i, v in enumerate(entries)],
                              "id string, embedding array<double>, country_code string")
    q = spark.createDataFrame([(i, v.tolist(), [None, "A"][i % 2]) for i, v in enumerate(asked)],
                              "question_id bigint, vector array<double>, country string")
    got = {}
    rows = retrieval.nearest_entries(q, e, 4, question_block, entry_block).orderBy("rank").collect()
    for r in rows:
        got.setdefault((r.question_id, r.scoped), []).append(r.id)
    sims = np.round(asked @ entries.T, 9)
    want = {}
    for i in range(9):
        order = sorted(range(40), key=lambda j: (-sims[i, j], j))
        want[i, False] = [f"{j:03d}" for j in order[:4]]
        if i % 2:
            want[i, True] = [f"{j:03d}" for j in order if j % 2 == 0][:4]
    assert got == want


def test_fallback_among_several_blocks(spark, index, tmp_path):
    """Questions without a country, from stored texts, look through an index of more than one block."""
    ask(spark, "What is happening in Zimbabwe?", "India votes", "floods", "Nikkei").write.parquet(str(tmp_path / "asked"))
    asked = retrieval.embed_questions(spark.read.parquet(str(tmp_path / "asked")), hashed_words)
    one, several = (
        sorted(map(tuple, retrieval.nearest_with_fallback(asked, index, 3, entry_block=n).collect())) for n in (16384, 2)
    )
    assert one == several and len(one) == 11


def test_a_cell_of_copies_returns_k_entries_a_question():
    """Of equal entries those with the smallest ids stay, whatever their number."""
    entries = [(f"{i:03d}", 1, [1.0, 0.0]) for i in range(50, 0, -1)] + [("999", 1, [0.0, 1.0])]
    rows = entries + [("1", 0, [1.0, 0.0]), ("2", 0, [0.0, 1.0])]
    cell = pa.table({n: [r[i] for r in rows] for i, n in enumerate(("id", "role", "vector"))})
    got = retrieval._nearest(3)(cell).to_pylist()
    assert sorted((r["question_id"], r["id"]) for r in got) == [(1, "001"), (1, "002"), (1, "003"), (2, "001"), (2, "002"), (2, "999")]


def test_prompt_and_sources(spark, index):
    rows = retrieval.answer_questions(ask(spark, "News from Japan?"), index, hashed_words).first()
    assert "Context:\n- Tokyo stock market rallies: Nikkei hits record high\n\nQuestion: News from Japan?\nAnswer:" in rows.prompt
    assert [tuple(s) for s in rows.sources] == [("Tokyo stock market rallies", None, "2026-07-04T12:00:00+00:00")]


def test_empty_index(spark, index):
    row = retrieval.answer_questions(ask(spark, "Hello"), index.limit(0), hashed_words).first()
    assert row.sources is None and "Context:\n\n\nQuestion: Hello" in row.prompt


def test_upsert_replaces_the_whole_entry(spark):
    log = spark.createDataFrame(
        [("a", "old", "x", 1), ("a", "new", None, 2), ("b", "b", "b", 1)], "id string, title string, summary string, load_seq int"
    )
    got = {r.id: (r.title, r.summary) for r in retrieval.upsert_index(log).collect()}
    assert got == {"a": ("new", None), "b": ("b", "b")}


@pytest.mark.parametrize("text, code", [
    ("What is happening in India?", "IN"), ("INDIA", "IN"), ("Indiana votes", None), ("south sudan", "OD"),
    ("Mali and the United States", "US"), ("Serbia", "RI"), ("nothing here", None), ("", None),
    ("Papua New Guinea", "PP"), ("Niger and Nigeria", "NI"), ("Cote D'Ivoire", "IV"), ("Chad Cuba", "CU"),
])
def test_country(spark, text, code):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(detect_country(F.col("t"))).first()[0] == code


def test_all_entries_are_searched_only_where_needed(spark):
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], "US"), (2, [1.0, 0.0], "ZI"), (3, [0.0, 1.0], None)],
        "question_id bigint, vector array<double>, country string",
    )
    index = spark.createDataFrame(
        [("a", [1.0, 0.0], "FR"), ("b", [0.6, 0.8], "US"), ("c", [0.0, 1.0], None)],
        "id string, embedding array<double>, country_code string",
    )
    rows = retrieval.nearest_with_fallback(asked, index, k=2).collect()
    got = sorted((r.question_id, r.scoped, r.rank, r.id) for r in rows)
    assert got == [
        (1, True, 1, "b"), (2, False, 1, "a"), (2, False, 2, "b"), (3, False, 1, "c"), (3, False, 2, "b"),
    ]
