"""Vector index upsert and exact nearest-neighbour retrieval for many questions in one job.

Questions and index entries are cut into bounded blocks; a (question block, entry block) combination is
one cell computed as a matrix product. A cell returns at most ``k`` entries per question and scope, so
the ranking after it is small.

The entries of a search among all lie around pivots. A question looks into the block of its nearest pivot
first. Its k-th best similarity there is a bound: a block whose pivot is farther away than the bound's
angle and the block's radius together can't hold a better entry, or an equal one, and is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.geo import detect_country
from wirepulse.functions.text import answer_prompt, context_line
from wirepulse.operators.ranking import latest_per_key, top_k_per_group
from wirepulse.operators.similarity import (
    DIGITS, SLACK, Blocks, angles_to, block_lists, lay_out, similarity_chunks, slices, to_matrix,
)
from wirepulse.session import fresh_path

QUESTION_BLOCK = 4096
ENTRY_BLOCK = 16_384
TOP_K = 5


def upsert_index(log: DataFrame, key: str = "id", order: str = "load_seq") -> DataFrame:
    """Newest entry per id of an append log; an entry is replaced as a whole."""
    return latest_per_key(log, [key], [F.desc(order)])


def index_articles(articles: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Add ``embedding`` of the document text."""
    return articles.withColumn("embedding", embed(F.col("document")))


def _rows(table: pa.Table, role: int) -> pa.Table:
    return table.filter(pc.equal(table.column("role"), role)).sort_by("id")


def _nearest(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of a cell, each question's ``k`` nearest entries; of those tied with the last the ones with the
    smallest ids, so that a cell of copies returns no more than others."""

    def rank(table: pa.Table) -> pa.Table:
        questions, entries = _rows(table, 0), _rows(table, 1)
        asked, found, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        left, right = to_matrix(questions.column("vector")), to_matrix(entries.column("vector"))
        for start, sims in similarity_chunks(left, right):
            if sims.shape[1] > k:
                last = sims.shape[1] - k
                least = np.partition(sims, last, axis=1)[:, last].copy()
                near = sims >= least[:, None]
                for i in np.flatnonzero(near.sum(axis=1) > k):  # entries are sorted by id
                    tied = np.flatnonzero(sims[i] == least[i])
                    near[i, tied[k - int((sims[i] > least[i]).sum()) :]] = False
            else:
                near = np.ones_like(sims, bool)
            row, column = np.nonzero(near)
            asked.append(start + row)
            found.append(column)
            values.append(sims[row, column])
        return pa.table(
            {
                "question_id": pc.cast(questions.column("id").take(pa.array(np.concatenate(asked))), pa.int64()),
                "id": entries.column("id").take(pa.array(np.concatenate(found))),
                "similarity": pa.array(np.concatenate(values), pa.float64()),
            }
        )

    return rank


def _search(
    questions: DataFrame, index: DataFrame, scope: str | None, k: int, question_block: int, entry_block: int
) -> DataFrame:
    """(question_id, scoped, rank, id, similarity) of the nearest entries among those with the same
    value in column ``scope`` of both sides, or among all.

    Each scope's questions and entries are cut into as many blocks as their numbers ask for, so a
    large scope is many cells and small ones are a cell each.
    """
    name = F.col(scope) if scope else F.lit("")
    q, e = questions.withColumn("_scope", name), index.withColumn("_scope", name)
    if scope is None:
        qs, es = (max(1, math.ceil(x.count() / n)) for x, n in ((questions, question_block), (index, entry_block)))
        q, e = (x.withColumns({"qs": F.lit(qs), "es": F.lit(es)}) for x in (q, e))
    else:
        blocks = (
            q.groupBy("_scope").agg(F.ceil(F.count("*") / question_block).cast("int").alias("qs"))
            .join(e.groupBy("_scope").agg(F.ceil(F.count("*") / entry_block).cast("int").alias("es")), "_scope")
        )
        q, e = (x.join(blocks, "_scope") for x in (q, e))
    sides = []
    for side, key, own, other, mine, vector, role in (
        (q, "question_id", "qb", "eb", "qs", "vector", 0), (e, "id", "eb", "qb", "es", "embedding", 1)
    ):
        opposite = "es" if mine == "qs" else "qs"
        sides.append(
            side.select(
                "_scope", F.pmod(F.xxhash64(key), F.col(mine)).cast("int").alias(own),
                F.explode(F.sequence(F.lit(0), F.col(opposite) - 1)).alias(other),
                F.lit(role).alias("role"), F.col(key).cast("string").alias("id"), F.col(vector).alias("vector"),
            )
        )
    partial = (
        sides[0].unionByName(sides[1]).groupBy("_scope", "qb", "eb")
        .applyInArrow(_nearest(k), "question_id bigint, id string, similarity double")
        .withColumn("scoped", F.lit(scope is not None))
    )
    return _ranked(partial, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("similarity"), F.asc("id")]
    return top_k_per_group(found, ["question_id", "scoped"], order, k, ["id"], rank="rank")


def visits(questions: DataFrame, layout: Blocks, k: int, first: DataFrame) -> DataFrame:
    """(question_id, vector, block): the blocks that each question still has to look into, after the hits
    of its ``block`` in ``first``. With fewer than ``k`` hits, and for a zero vector, these are all."""
    bound = first.groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("_least"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(layout.parts)), layout.parts)
        for rows in slices(batches):
            matrix = to_matrix(pa.chunked_array([rows.column("vector")]))
            least = rows.column("_least").to_numpy(zero_copy_only=False).astype(float)
            reach = np.arccos(np.clip(least - 10.0**-DIGITS, -1.0, 1.0)) + SLACK
            reach[np.isnan(reach) | ~matrix.any(axis=1)] = np.inf
            where = layout.visits(angles_to(matrix, layout.pivots), reach)
            where &= np.isfinite(layout.radius)
            spread = where[:, owner]
            spread[np.arange(len(matrix)), rows.column("block").to_numpy()] = False
            yield pa.RecordBatch.from_arrays(
                [rows.column("question_id"), rows.column("vector"), block_lists(spread)], ["question_id", "vector", "_to"]
            )

    rows = questions.join(bound, "question_id", "left").select("question_id", "vector", "block", "_least")
    found = rows.mapInArrow(needed, "question_id bigint, vector array<double>, _to array<int>")
    return found.select("question_id", "vector", F.explode("_to").alias("block"))


def _home(questions: DataFrame, layout: Blocks) -> DataFrame:
    """(question_id, vector, block): a block of the nearest pivot that has entries."""
    first, parts = layout.first, layout.parts
    used = np.flatnonzero(np.isfinite(layout.radius))

    @F.pandas_udf("int")
    def nearest(vector: pd.Series, hashed: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype="int32")
        pivot = used[angles_to(np.array(vector.tolist(), float), layout.pivots[used]).argmin(axis=1)]
        return pd.Series((first[pivot] + hashed.to_numpy() % parts[pivot]).astype(np.int32), index=vector.index)

    hashed = F.pmod(F.xxhash64("question_id"), F.lit(1 << 30))
    dense = questions.select("question_id", F.col("vector").cast("array<double>").alias("vector"))
    return dense.withColumn("block", nearest("vector", hashed))


def _search_all(questions: DataFrame, index: DataFrame, k: int, question_block: int, entry_block: int) -> DataFrame:
    """``_search`` among all entries; one block of entries is searched whole, of more the far ones are
    skipped."""
    blocks = math.ceil(index.count() / entry_block)
    if blocks <= 1:
        return _search(questions, index, None, k, question_block, entry_block)
    entries, layout = lay_out(index.select("id", "embedding"), blocks, "id", "embedding")
    # Stored, so that the optimizer can't move a filter on the block, a Python function's result, below a join.
    home = fresh_path(index.sparkSession, "home-blocks")
    _home(questions, layout).write.parquet(home)
    asked = index.sparkSession.read.parquet(home)
    path = fresh_path(index.sparkSession, "first-probe")
    _search(asked, entries, "block", k, question_block, entry_block).write.parquet(path)
    first = index.sparkSession.read.parquet(path)
    more = _search(visits(asked, layout, k, first), entries, "block", k, question_block, entry_block)
    hits = first.unionByName(more).drop("rank").withColumn("scoped", F.lit(False))
    return _ranked(hits, k)


def nearest_entries(
    questions: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    question_block: int = QUESTION_BLOCK,
    entry_block: int = ENTRY_BLOCK,
) -> DataFrame:
    """(question_id, scoped, rank, id, similarity).

    ``questions``: question_id bigint, vector, country (NULL = no scope). ``index``: id string,
    embedding, country_code. Every question gets its unscoped top ``k``; one with a country also
    gets the top ``k`` among entries of that country. Ties go to the smaller id.
    """
    scoped = _in_country(questions, index, k, question_block, entry_block)
    return _search_all(questions, index, k, question_block, entry_block).unionByName(scoped)


def _in_country(
    questions: DataFrame, index: DataFrame, k: int, question_block: int, entry_block: int
) -> DataFrame:
    named = questions.filter(F.col("country").isNotNull())
    entries = index.withColumn("country", F.col("country_code")).filter(F.col("country").isNotNull())
    return _search(named, entries, "country", k, question_block, entry_block)


def nearest_with_fallback(
    questions: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    question_block: int = QUESTION_BLOCK,
    entry_block: int = ENTRY_BLOCK,
) -> DataFrame:
    """The same, with the entries of a question's country only; all entries are searched just for
    questions that name no country or one without entries."""
    countries = index.select(F.col("country_code").alias("country")).distinct()
    without = questions.join(countries, "country", "left_anti")
    scoped = _in_country(questions, index, k, question_block, entry_block)
    return scoped.unionByName(_search_all(without, index, k, question_block, entry_block))


def embed_questions(questions: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Add the question's vector and the country it names (whole text, NULL if none)."""
    return questions.withColumns(
        {"vector": embed(F.col("question")), "country": detect_country(F.col("question"))}
    )


def answer_context(questions: DataFrame, hits: DataFrame, index: DataFrame) -> DataFrame:
    """(question_id, prompt, sources) from ranked hits; at most ``k`` rows meet per question."""
    entry = index.select("id", "title", "summary", "source_url", "date_added")
    line = context_line(F.col("title"), F.col("summary"))
    source = F.struct("title", F.nullif("source_url", F.lit("")).alias("source_url"), "date_added")
    grouped = (
        hits.join(entry, "id")
        .groupBy("question_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", line.alias("line"), source.alias("source")))
            ).alias("r")
        )
    )
    lines = F.coalesce(F.transform("r", lambda x: x["line"]), F.array().cast("array<string>"))
    return questions.join(grouped, "question_id", "left").select(
        "question_id",
        answer_prompt(F.col("question"), lines).alias("prompt"),
        F.transform("r", lambda x: x["source"]).alias("sources"),
    )


def answer_questions(
    questions: DataFrame, index: DataFrame, embed: Callable[[Column], Column], k: int = TOP_K
) -> DataFrame:
    """Prompt and sources per question: country detection, scoped search, fallback, context.

    Generating the answer from the prompt is left to the caller.
    """
    prepared = embed_questions(questions, embed)
    hits = nearest_with_fallback(prepared, index, k)
    return answer_context(questions, hits, index)
