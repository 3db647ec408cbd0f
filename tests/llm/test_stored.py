"""Intermediate tables: what they hold, and what a write leaves behind."""

from pyspark.sql import functions as F

from wirepulse.llm.common import _CLEANUP, stored


def test_a_stored_table_is_read_back_and_settings_stay(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("s"))
    before = spark.conf.get(_CLEANUP, None)
    back = stored(df, "sums")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert spark.conf.get(_CLEANUP, None) == before
    # The source may be shuffled again after its first shuffle files are gone.
    assert sorted(map(tuple, stored(df, "sums").collect())) == sorted(map(tuple, back.collect()))


def test_an_empty_table_keeps_its_columns(spark):
    back = stored(spark.createDataFrame([], "doc_id long, text string"), "none")
    assert back.columns == ["doc_id", "text"] and back.count() == 0
