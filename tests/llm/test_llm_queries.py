import pytest

import corpus_pipeline
from __spark_entry__ import queries
from tests.compare import compare, duck
from tests.llm.conftest import prose
from wirepulse.llm.oracles import ORACLES
from wirepulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_keep_the_columns_and_clean_documents(spark, documents, no_documents):
    docs = documents.select(corpus_pipeline.DOCUMENT_COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "stage")
        assert {r.doc_id for r in docs.collect()} <= before, name
        if name == "n-gram join":
            assert 1 in before and {r.doc_id for r in docs.collect()} == before - {2, 3}
        if name != "packing":
            assert docs.columns == corpus_pipeline.DOCUMENT_COLUMNS
    assert {4, 10} <= {r.doc_id for r in docs.collect()}
    assert docs.columns[0] == "doc_id"
    empty = no_documents.select(corpus_pipeline.DOCUMENT_COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, SF), "stage")
    assert empty.count() == 0


def test_one_row_of_a_group_stays_whatever_the_ids(spark):
    a, b, c, d = (prose(i, 60) for i in range(4))
    near = f"{a} end"
    rows = [(1, a), (1, a), (1, b), (2, near), (None, c), (None, c), (None, d), (3, d), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'h' as source", "coalesce(length(text), 0L) as n_chars"
    )
    got = corpus_pipeline.ngram_join(spark, df, SF)
    assert got.columns == corpus_pipeline.DOCUMENT_COLUMNS
    want = [(1, a), (1, b), (None, c), (3, d), (4, None), (5, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
