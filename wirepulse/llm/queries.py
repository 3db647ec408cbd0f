"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.llm.chat_format import canonical_turns, chat_digests, format_turns
from wirepulse.llm.common import table
from wirepulse.llm.decontamination import benchmark_overlaps
from wirepulse.llm.lexical_search import search
from wirepulse.llm.ngram_join import JoinRule, similarity_components
from wirepulse.llm.packing import pack_documents
from wirepulse.llm.quality_rules import judge_quality
from wirepulse.llm.records import read_records, write_records
from wirepulse.llm.sharding import histogram_shards
from wirepulse.llm.suffix_dedup import remove_repeats
from wirepulse.llm.toxicity import fit_toxicity, is_held_out, toxic_passages
from wirepulse.llm.turn_repair import audit_conversations, damage
from wirepulse.llm.url_filter import filter_urls
from wirepulse.llm.warc import read_warc, write_warc
from wirepulse.session import fresh_path

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxic_passages(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"), JoinRule(size=3, percent=90))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "lost_words",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    )
    shards = histogram_shards(docs, 40, F.col("size"), F.col("text_hash"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def vocabulary() -> str:
    """The tokenizer file of the queries; every executor has it at this path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).drop("url")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-records")
    write_records(table(spark, sf_dir, "documents"), path, vocabulary())
    return read_records(spark, path, with_ids=False)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = canonical_turns(table(spark, sf_dir, "conversations"), "conv_id")
    control = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    return chat_digests(format_turns(turns.unionByName(hard)))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_records": op10_records,
    "op11_chat_format": op11_chat_format,
    "op12_lexical_search": op12_lexical_search,
    "op13_turn_repair": op13_turn_repair,
}
