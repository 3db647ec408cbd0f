import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.conftest import prose
from wirepulse.llm import decontamination
from wirepulse.llm.decontamination import LEAST_SCORE, benchmark_overlaps
from wirepulse.llm.quality_rules import LineLimits, judge_quality
from wirepulse.llm.sharding import histogram_shards
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures(spark, documents, no_documents):
    tricky = ["#a *b\n\n#a *b\n \n x|<y>&$%", " lead trail \n", "a b c d e f g h " * 3, "a b c d e f g h", "q " * 9, "x\x0by\x85z"]
    rows = [(100 + i, t) for i, t in enumerate(tricky)]
    more = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' as source", "true as kept")
    for df in (documents, more):
        got = judge_quality(df)
        assert [c for c in df.columns if c != "kept"] == got.columns[: len(df.columns) - df.columns.count("kept")]
        for r in got.collect():
            assert tuple(r[c] for c in COLUMNS) == measures(r.text), r.text
    assert judge_quality(no_documents).count() == 0
    assert judge_quality(documents).count() == documents.count()


def test_boilerplate_depletes_only_what_consists_of_it(spark):
    line = prose(7, 15)
    rows = [(i, f"{prose(i + 10, 4)}\n{line}\n{line.upper()}", "h") for i in range(30)]  # nothing else
    rows += [(100 + i, f"{prose(i + 50, 80)}\n{line}", "h") for i in range(30)]  # prose and the line
    rows += [(200 + i, prose(500, 60), "h") for i in range(60)]  # copies of one text
    rows += [(300, f"{line}\n{line}", "other"), (301, prose(501, 60), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r for r in judge_quality(df, limits=LineLimits(line_docs=20, line_share=0.3)).collect()}
    assert not any(kept[i].kept for i in range(30)) and kept[3].lost_words == 30
    assert all(kept[100 + i].kept and kept[100 + i].lost_words == 15 for i in range(30))
    assert all(kept[200 + i].kept and not kept[200 + i].lost_words for i in range(60))
    assert kept[301].kept


def test_boilerplate_lines_leave_the_text(spark):
    line = prose(7, 15)
    rows = [(i, f"{prose(i + 10, 40)}\n\n {line.upper()} \n{prose(i + 90, 40)}\n{line}", "h") for i in range(30)]
    rows += [(100 + i, f"{line}\nA  b\n{prose(i + 300, 60)}", f"other{i}") for i in range(2)] + [(200, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("clean_text", F.lit("old"))
    got = {r.doc_id: r.clean_text for r in judge_quality(df).collect()}
    assert got == {i: f"{prose(i + 10, 40)}\n\n{prose(i + 90, 40)}" if i < 30 else t for i, t, _ in rows}
    docs = df.selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars")
    stage = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in stage} == {k: t for k, t in got.items() if t is not None}
    assert all(r.n_chars == len(r.text) for r in stage)


def test_a_line_in_very_many_texts_of_a_large_host_is_boilerplate(spark):
    line, rare = prose(7, 60), prose(8, 60)
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat_ws("_", "id", i)), " ")
    tail = F.when(F.col("id") < 1100, F.lit(line)).when(F.col("id") < 2050, F.lit(rare)).otherwise(F.lit("end"))
    df = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", own, tail).alias("text"), F.lit("h").alias("source"))
    got = [tuple(r) for r in judge_quality(df).filter("doc_id < 2050").select("doc_id", "lost_words", "kept", "base_failed").collect()]
    assert sorted(got) == [(i, 60, False, False) if i < 1100 else (i, 0, True, False) for i in range(2050)]


def test_lost_words_are_the_row_s_own(spark):
    line = prose(7, 15)
    rows = [(5, f"{prose(10, 35)}\n{line}", "h")] * 3 + [(5, prose(11, 40), "h"), (5, f"{prose(10, 35)}\n{line}", "g")]
    rows += [(None, f"{prose(12, 12)}\n{line}", "h"), (None, f"{prose(13, 60)}\n{line}", "h")]
    rows += [(100 + i, f"{prose(i + 50, 80)}\n{line}", "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = judge_quality(df).filter("doc_id is null or doc_id = 5")
    assert sorted((r.doc_id or 0, r.n_words, r.source, r.lost_words, r.kept) for r in got.collect()) == [
        (0, 27, "h", 15, False), (0, 75, "h", 15, True), (5, 40, "h", 0, True), (5, 50, "g", 0, True),
        *[(5, 50, "h", 15, True)] * 3,
    ]


def test_shards_have_equal_bytes_and_whole_groups(spark, documents, no_documents):
    rows = [(i, prose(i % 150, 30 + i % 40)) for i in range(900)] + [(2000 + i, prose(1, 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("old"))
    size = F.length("text")
    got = histogram_shards(df, 7, size, F.col("text"), bins=3).withColumn("size", size).toPandas()
    assert len(got) == len(rows) and sorted(got.doc_id) == sorted(i for i, _ in rows)
    by = got.groupby("shard")
    assert set(by.groups) == set(range(7))
    assert (by["size"].sum() - got["size"].sum() / 7).abs().max() <= 2 * got["size"].max()
    for _, part in by:
        assert sorted(part.slot) == list(range(len(part)))
    # A group lies in neighbouring shards: only as many as its bytes need.
    assert got[got.doc_id >= 2000].shard.nunique() <= 7 * 600 * 50 / 1500 / 30
    odd = histogram_shards(documents, 3, F.coalesce(F.length("text"), F.lit(0)) + 1, F.col("text")).collect()
    assert len(odd) == documents.count() and {r.shard for r in odd} <= {0, 1, 2}
    assert histogram_shards(no_documents, 3, F.lit(1), F.col("text")).count() == 0
    assert {r.shard for r in histogram_shards(documents, 1, F.lit(1), F.col("text")).collect()} == {0}


def test_benchmark_passages_with_replaced_words(spark, documents, no_documents):
    item = prose(80, 40).split()
    rng = np.random.default_rng(3)
    edited = [w if i % 9 else "swap" for i, w in enumerate(item)]
    scattered = [w if rng.random() < 0.4 else f"x{i}" for i, w in enumerate(item)]
    text = lambda words: f"{prose(81, 50)} {' '.join(words)} {prose(82, 50)}"
    rows = [
        (1, text(item)), (2, text([w.upper() + "," for w in item])), (3, text(edited)), (4, text(scattered)),
        (5, text(item[:7])), (6, " ".join(item)), (7, " ".join(item[10:25])), (8, None), (9, ""), (1, text(item)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None), (None, prose(90, 30))], "item_id long, text string")
    got = {r.doc_id: r for r in benchmark_overlaps(df, bench).collect()}
    assert set(got) == {1, 2, 3, 6, 7} and {r.item_id for r in got.values()} == {0}
    assert got[1].n_matched == 40 and got[3].score >= LEAST_SCORE
    assert benchmark_overlaps(no_documents, bench).count() == 0
    assert benchmark_overlaps(documents, bench.filter("false")).count() == 0


def test_both_ways_of_joining_the_seeds_agree(spark):
    """Also on a very long text, on repeated and null ids, and where every fourth word is replaced."""
    items = [prose(400 + i, 48) for i in range(6)]
    fourth = " ".join(w if i % 4 else f"y{i}" for i, w in enumerate(items[1].split()))
    long = " ".join([prose(420, 9000), items[0], prose(421, 9000), items[2][:-40], prose(422, 2000)])
    rows = [(1, long), (1, items[3]), (None, f"{prose(430, 20)} {items[0]}"), (None, prose(431, 80)), (2, fourth), (3, prose(432, 400)), (2, fourth)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as seed", "3 as _row", "4 as _at")
    bench = spark.createDataFrame([*enumerate(items), (None, items[5])], "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as mask")
    sent, joined = (
        sorted(map(tuple, benchmark_overlaps(df, bench, most_broadcast=n).collect()), key=repr) for n in (10**6, 0)
    )
    assert sent == joined
    assert {(d, i) for d, i, _, _ in sent} == {(1, 0), (1, 2), (1, 3), (None, 0), (2, 1)}


def test_many_benchmark_windows_are_neither_broadcast_nor_shuffled_against_all(spark):
    """The tables are small by Spark's estimate; their windows are not. Few windows of the documents are in an item."""
    words = lambda t: F.transform(F.split(t, " "), lambda w: F.xxhash64(w))
    docs = spark.createDataFrame([(i, prose(500 + i, 300)) for i in range(40)], "_doc long, _text string").withColumn("_row", F.col("_doc"))
    sets = spark.createDataFrame([(i, prose(500 + 9 * i, 40)) for i in range(4)], "_set long, t string")
    sets = sets.select("_set", words("t").alias("_item_words"))
    found = decontamination.shuffled_hits(docs, sets, 4 * 40 * len(decontamination.MASKS))
    assert {(r._row, r._set) for r in found.filter("_shift = 0").collect()} == {(9 * i, i) for i in range(4)}
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    hashes = spark.range(3000).withColumn("h", F.xxhash64("id"))
    known = decontamination.may_hold(hashes.filter("id < 1000"), "h", 1000)
    assert hashes.filter("id < 1000").filter(known(F.col("h"))).count() == 1000
    assert hashes.filter("id >= 1000").filter(known(F.col("h"))).count() < 200


def test_items_of_equal_words_are_compared_once_and_all_reported(spark):
    item = prose(600, 40)
    bench = spark.createDataFrame([(i, item.upper() if i % 2 else item) for i in range(300)], "item_id long, text string")
    df = spark.createDataFrame([(7, f"{prose(601, 30)} {item}"), (8, prose(602, 60))], "doc_id long, text string")
    # The windows of one set are few enough to be sent.
    got = benchmark_overlaps(df, bench, most_broadcast=40 * len(decontamination.MASKS))
    assert got.count() == 300 and {(r.doc_id, r.score, r.n_matched) for r in got.collect()} == {(7, 40, 40)}
    assert "BroadcastHashJoin [mask" in got._jdf.queryExecution().sparkPlan().toString()


def test_pipeline_stage_judges_rows_not_ids(spark, tmp_path):
    item = prose(440, 40)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = prose(441, 60)
    rows = [(None, f"{prose(442, 9)} {item}"), (None, clean), (7, item), (7, clean), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'h' as source", "1L as n_chars")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, clean), (7, clean), (8, None)], key=repr)
