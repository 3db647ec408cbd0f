"""Ranked lexical search by scanning the documents for the terms of all items at once.

The distinct terms of a block of items make an Aho-Corasick automaton over bytes, each term between two
guards. A document's bytes that are no part of a term are guards too, so exactly whole terms are found,
and their number in a document is its tf; there is no index of the documents. A first scan counts the
documents, their terms and each term's documents, a second one scores. The outputs of the automaton
lead to the items that have the term; a task keeps the best documents of each item only.

Term weights and scores are integers, so results don't depend on the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.llm.common import ascii_lower, blocks, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# (item, term) pairs of one automaton; items beyond it are searched in further scans.
MOST_PAIRS = 2_000_000
_GUARD = 0x20
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else _GUARD for c in range(128)]
_DOCUMENTS, _TERMS = -1, -2
_CELLS = 1 << 20  # (document, item) scores held at once


@dataclass
class TermAutomaton:
    """The automaton of the terms, and the items of each: those of term t are
    ``item_of[first[t]:first[t + 1]]``, numbers in ``items``."""

    automaton: ahocorasick.Automaton
    first: np.ndarray
    item_of: np.ndarray
    items: pa.Array

    @property
    def n_terms(self) -> int:
        return len(self.first) - 1


def build_automaton(pairs: list[tuple[object, str]], item_type: pa.DataType) -> TermAutomaton:
    """From distinct (item, term) pairs; terms are cut to bytes, one character for each."""
    terms = sorted({t for _, t in pairs})
    ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    term_at, item_at = {t: n for n, t in enumerate(terms)}, {i: n for n, i in enumerate(ids)}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    guard = chr(_GUARD)
    for term, n in term_at.items():
        automaton.add_word(f"{guard}{term.encode().decode('latin-1')}{guard}", n)
    automaton.make_automaton()
    which = np.array([term_at[t] for _, t in pairs], np.int64)
    order = np.argsort(which, kind="stable")
    item_of = np.array([item_at[i] for i, _ in pairs], np.int64)[order]
    first = np.searchsorted(which[order], np.arange(len(terms) + 1))
    return TermAutomaton(automaton, first, item_of, pa.array(ids, item_type))


def scan(own: TermAutomaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(terms of each text, document and term and tf of each pair that occurs) of a block of texts."""
    n = len(offsets) - 1
    guarded = np.full(len(data) + n + 1, _GUARD, np.uint8)
    guarded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _BYTES[data]
    inside = guarded != _GUARD
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    bounds = offsets + np.arange(n + 1)  # a text lies behind its guard
    lengths = np.diff(np.searchsorted(starts, bounds))
    text = guarded.tobytes().decode("latin-1")
    found = np.fromiter(chain.from_iterable(own.automaton.iter(text)), np.int64).reshape(-1, 2)
    # A match ends at the guard behind its term.
    document = np.searchsorted(bounds, found[:, 0] - 1, "right") - 1
    pairs, tf = np.unique(document * own.n_terms + found[:, 1], return_counts=True)
    return lengths, pairs // own.n_terms, pairs % own.n_terms, tf


class _Best:
    """The best documents of each item so far: highest score, then smallest id, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.floor = np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64)] * 4  # item, score, no id, id
        self.more: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, item: np.ndarray, score: np.ndarray, no_id: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= self.floor[item]
        self.more.append([x[keep] for x in (item, score, no_id, doc)])
        self.waiting += int(keep.sum())
        if self.waiting > max(2 * self.top * len(self.floor), 100_000):
            self.shrink()

    def shrink(self) -> None:
        if self.more:
            self.rows = [np.concatenate([a, *b]) for a, b in zip(self.rows, zip(*self.more, strict=True), strict=True)]
        item, score, no_id, doc = self.rows
        order = np.lexsort((doc, no_id, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.top - 1
        self.floor[item[full]] = score[order[full]]
        self.rows = [x[order[rank < self.top]] for x in self.rows]
        self.more, self.waiting = [], 0


def _counts(documents: DataFrame, own, text: str) -> dict[int, int]:
    """Documents of each term, of any term (``_DOCUMENTS``) and all terms (``_TERMS``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = own.value
        df, total = np.zeros(lexicon.n_terms, np.int64), np.zeros(2, np.int64)
        for _, data, offsets in blocks(batches, text):
            lengths, _, term, _ = scan(lexicon, data, offsets)
            df += np.bincount(term, minlength=lexicon.n_terms)
            total += np.count_nonzero(lengths), lengths.sum()
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, [_DOCUMENTS, _TERMS])), pa.array(np.append(df[used], total))], ["term", "n"]
        )

    counted = documents.select(text).mapInArrow(count, "term long, n long")
    return {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _scored(documents: DataFrame, own, weights, n_docs: int, n_terms: int, top: int, names: tuple[str, str, str], item_kind: str) -> DataFrame:
    item, key, text = names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weight = own.value, weights.value
        best = _Best(len(lexicon.items), top)
        per_term = np.diff(lexicon.first)
        step = max(1, _CELLS // max(len(lexicon.items), 1))
        for rows, data, offsets in blocks(batches, text):
            lengths, doc, term, tf = scan(lexicon, data, offsets)
            m = 100 - 50 + (50 * lengths * n_docs) // max(n_terms, 1)
            part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            ids = rows.column(key)
            no_id = np.array(ids.is_null(), bool).astype(np.int64)
            ids = np.array(ids.fill_null(0), np.int64)
            for a in range(0, len(lengths), step):
                lo, hi = np.searchsorted(doc, [a, a + step])
                times = per_term[term[lo:hi]]
                ends = np.cumsum(times)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lexicon.first[term[lo:hi]] - ends + times, times)
                cells = np.repeat(doc[lo:hi] - a, times) * len(lexicon.items) + lexicon.item_of[at]
                sums = np.zeros(min(step, len(lengths) - a) * len(lexicon.items), np.int64)
                np.add.at(sums, cells, np.repeat(part[lo:hi], times))
                hit = np.flatnonzero(sums)
                row = hit // len(lexicon.items) + a
                best.add(hit % len(lexicon.items), sums[hit], no_id[row], ids[row])
        best.shrink()
        which, points, no_id, ids = best.rows
        yield pa.RecordBatch.from_arrays(
            [lexicon.items.take(pa.array(which)), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(points)],
            [item, key, "score"],
        )

    return documents.select(F.col(key).cast("long").alias(key), text).mapInArrow(
        score, f"`{item}` {item_kind}, `{key}` long, score long"
    )


def search(
    documents: DataFrame, items: DataFrame, top: int = 50, item: str = "item_id", key: str = "doc_id",
    text: str = "text", most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """(item, rank, key, score): the ``top`` highest-scoring documents of each item with a score above
    0, equal scores by ascending key (null last).

    Rows of one item id, or of null, are one item with all their terms. Null and empty texts have no
    terms; repeated documents are ranked each. Without documents or items the result is empty. Items
    are searched in blocks of about ``most_pairs`` (item, term) pairs, a single larger one by itself.
    """
    spark = documents.sparkSession
    item_kind = dict(items.dtypes)[item]
    terms = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    pairs = stored(items.select(item, F.explode(terms).alias("term")).distinct(), "item-terms")
    n_blocks = max(1, math.ceil(pairs.count() / most_pairs))
    found = []
    for block in range(n_blocks):
        own_pairs = pairs.filter(F.pmod(F.xxhash64(item), F.lit(n_blocks)) == block).collect()
        if not own_pairs:
            continue
        lexicon = build_automaton([(r[0], r[1]) for r in own_pairs], pa.int64() if item_kind in ("bigint", "int") else pa.string())
        if item_kind == "int":
            lexicon.items = lexicon.items.cast(pa.int32())
        own = spark.sparkContext.broadcast(lexicon)
        counts = _counts(documents, own, text)
        n_docs, n_terms = counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0)
        weights = spark.sparkContext.broadcast(
            np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(lexicon.n_terms)], np.int64)
        )
        found.append(_scored(documents, own, weights, n_docs, n_terms, top, (item, key, text), item_kind))
    if not found:
        return spark.createDataFrame([], f"`{item}` {item_kind}, rank int, `{key}` long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.asc_nulls_last(key))
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(item, "rank", key, "score")
