"""The training-data pipeline over ``documents``: each stage works on what the one before it kept.

Rejected documents and boilerplate lines go, one document of each group of near copies stays (one with the smallest
id), passages that repeat are cut out, documents with a benchmark passage go, and the rest is packed
into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.llm.common import stored, table
from wirepulse.llm.decontamination import benchmark_overlaps
from wirepulse.llm.ngram_join import JoinRule, similarity_components
from wirepulse.llm.packing import pack_documents
from wirepulse.llm.quality_rules import judge_quality
from wirepulse.llm.queries import vocabulary
from wirepulse.llm.suffix_dedup import remove_repeats

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_COPIES = JoinRule(size=5, percent=80)
REPEAT_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, and the boilerplate lines of the others."""
    return judge_quality(docs).filter("kept").select(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars")
    )


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents, of those with the smallest id; a null id is
    larger than any other. Rows are told apart by a hash of all columns, so ids may be repeated or null;
    rows that are equal throughout are one."""
    rows = docs.select(*DOCUMENT_COLUMNS, F.xxhash64(*DOCUMENT_COLUMNS).alias("_row"))
    groups = similarity_components(rows, NEAR_COPIES, key="_row").select("_row", "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    stay = rows.select("doc_id", "_row").join(groups, "_row").groupBy("component_id").agg(first.alias("_row"))
    return rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(DOCUMENT_COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts, by whole characters; documents of which nothing is
    left go."""
    left = remove_repeats(docs, length=REPEAT_BYTES, whole_characters=True, columns=("lang", "source"))
    return left.filter(F.trim("kept") != "").select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a passage of a benchmark item; rows are told apart by a hash of all
    columns, so ids may be repeated or null."""
    rows = docs.select(*DOCUMENT_COLUMNS, F.xxhash64(*DOCUMENT_COLUMNS).alias("_row"))
    overlaps = benchmark_overlaps(rows, table(spark, sf_dir, "benchmark"), key="_row")
    return rows.join(overlaps.select("_row").distinct(), "_row", "left_anti").select(DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram join", ngram_join),
    ("suffix dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Links between near copies and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
