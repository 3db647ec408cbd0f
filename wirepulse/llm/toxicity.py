"""Toxic passages by maximum-scoring segments.

Features of a word are the word (A-Z lower-cased, other characters than letters and digits part
words) and its first four to six bytes, which catch inflected forms. Every feature is hashed into one
of ``BUCKETS`` buckets. A bucket's weight is the log-odds of its share of toxic against clean training
texts under a Dirichlet prior, less ``DEVIATIONS`` standard deviations, so that rare features count
little, and zero below ``LEAST_WEIGHT``. A word's score is the largest weight of its features if that
is positive, else a small penalty, so that the expected score of clean prose is negative.

All maximal segments of a text's scores are found in one linear scan. Scores that are log-odds have
extreme-value distributed maxima with decay 1: K n exp(-s) segments of score s or more are expected by
chance in n words, with K the segments per word of the clean training texts. The r best segments are
judged together by the distribution of their normalised sum; the smallest chance over r gives the
posterior probability that is the text's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.common import Words, blocks, mix, stored

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
# Labelled rows to fit on, chosen by the hash of their id beyond it; and the strength of the prior.
MOST_ROWS = 2_000_000
PRIOR = 0.5
DEVIATIONS = 2.5
LEAST_WEIGHT = 1.0
PENALTY = 0.05
MOST_WEIGHT = 8.0
# Chance before a look at the text, below the usual share of toxic texts: a cautious judge.
PRIOR_TOXIC = 0.02
LEAST_RATE = 6e-3
_ALL = -1  # stands for the number of texts among the bucket counts


@dataclass
class ToxicityModel:
    """A score for each bucket (zero: no evidence), and the rate of chance segments a word."""

    scores: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    rate: float = LEAST_RATE


def is_held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from: CRC-32 of the id as text, modulo 4, is 2; false for a
    null id, which no label names either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(words: Words) -> np.ndarray:
    """(features, words) bucket numbers."""
    rows = [words.hashes]
    for n in PREFIXES:
        ends = np.minimum(words.starts + n, words.ends)
        rows.append(mix(words.range_hash(words.starts, ends) + np.uint64(n)))
    return (np.stack(rows) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class _Labels:
    """Labels by the 64-bit hash of their id, ascending; at most ``MOST_ROWS`` or what the caller set."""

    keys: np.ndarray
    toxic: np.ndarray

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, toxic) of the labelled rows of (hash, text)."""
        for rows in batches:
            keys = np.array(rows.column(0), np.int64)
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            found = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(1).take(pa.array(found)), pa.array(self.toxic[at[found]])], ["text", "toxic"]
            )


def _bucket_counts(texts: DataFrame, known) -> DataFrame:
    """(bucket, clean, toxic): number of labelled texts of each class that have the bucket, summed in
    each task first; the bucket ``_ALL`` has the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        texts_of = np.zeros(2, np.int64)
        for rows, data, offsets in blocks(known.value.of(batches), "text"):
            words = Words(data, offsets, plain=True)
            labels = np.array(rows.column("toxic"), np.int64)
            owner = np.repeat(np.arange(len(labels)), words.counts)
            pairs = np.unique((owner * BUCKETS + _features(words)).ravel())
            texts_of += np.bincount(labels, minlength=2)
            for c in (0, 1):
                own = pairs[labels[pairs // BUCKETS] == c] % BUCKETS
                sums[c] += np.bincount(own, minlength=BUCKETS)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": np.append(used, _ALL), "clean": np.append(sums[0][used], texts_of[0]),
                "toxic": np.append(sums[1][used], texts_of[1]),
            }
        )

    found = texts.mapInArrow(count, "bucket long, clean long, toxic long")
    return found.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _weight(clean: Column, toxic: Column, clean_texts: int, toxic_texts: int) -> Column:
    """A bucket's score from its counts, before it is compared with ``LEAST_WEIGHT``."""
    a, b = toxic + PRIOR, clean + PRIOR
    delta = F.log(a / (toxic_texts + 1)) - F.log(b / (clean_texts + 1))
    return F.least(delta - DEVIATIONS * F.sqrt(1 / a + 1 / b), F.lit(MOST_WEIGHT))


def word_scores(model: ToxicityModel, words: Words) -> np.ndarray:
    """The best weight among a word's features, or the penalty."""
    best = model.scores[_features(words)].max(axis=0)
    return np.where(best > 0, best, -PENALTY)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one text in linear time.

    Each positive run starts a candidate; a candidate merges with an earlier one when the sum before
    it is lower and its own end is higher. Only runs are visited, the penalties between them come
    from prefix sums.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    positive = scores > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    before: list[int] = []  # for each: the last earlier candidate with a lower sum before it, or -1
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        left, right = sums[start], sums[end]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = before[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                before.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], before[j:]
    return [(s, e, float(r - x)) for s, e, x, r in found]


def _all_segments(model: ToxicityModel, words: Words) -> Iterator[list[tuple[int, int, float]]]:
    scores = word_scores(model, words)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        own = scores[a:b]
        yield segments(own) if (own > 0).any() else []


def _chance_rate(model: ToxicityModel, texts: DataFrame, known) -> float:
    """Segments per word of the texts that are labelled clean."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2)
        clean = (rows.filter(pc.equal(rows.column("toxic"), 0)) for rows in known.value.of(batches))
        for _, data, offsets in blocks(clean, "text"):
            words = Words(data, offsets, plain=True)
            total += sum(len(x) for x in _all_segments(model, words)), len(words.hashes)
        yield pa.RecordBatch.from_pydict({"found": [total[0]], "words": [total[1]]})

    sums = texts.mapInArrow(measure, "found double, words double").agg(F.sum("found"), F.sum("words")).first()
    return max(LEAST_RATE, (sums[0] or 0) / max(sums[1] or 0, 1))


def fit_toxicity(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> ToxicityModel:
    """A model from the labelled rows that aren't held out; null labels and texts are left out.

    The model has a fixed size: one number for each bucket. Of more than ``most_rows`` labelled rows
    those with the smallest hashed ids are taken. A document with several labels is toxic if one
    says so. Without toxic rows every score stays zero.

    The labels go to the tasks that scan the documents, 9 bytes a row and therefore of a bounded size;
    no text is shuffled.
    """
    known = (
        labels.filter("toxic is not null and doc_id is not null").filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic") > 0).cast("long").alias("toxic"))
    )
    n = known.count()
    if n > most_rows:
        share = int(most_rows / n * (1 << 32))
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share)
    rows = known.select(F.xxhash64("doc_id").alias("key"), F.col("toxic").cast("tinyint").alias("toxic")).toArrow()
    keys, toxic = rows.column("key").to_numpy(), rows.column("toxic").to_numpy()
    order = np.argsort(keys)
    sent = documents.sparkSession.sparkContext.broadcast(_Labels(keys[order], toxic[order]))
    texts = documents.filter("text is not null and doc_id is not null").select(F.xxhash64("doc_id").alias("key"), "text")
    counts = stored(_bucket_counts(texts, sent), "toxicity-counts")
    totals = counts.filter(F.col("bucket") == _ALL).first()
    model = ToxicityModel()
    if totals is None or not totals["toxic"]:
        return model
    weight = _weight(F.col("clean"), F.col("toxic"), totals["clean"], totals["toxic"])
    strong = counts.filter("bucket >= 0 and toxic > 0").select("bucket", weight.alias("w"))
    for bucket, w in strong.filter(F.col("w") >= LEAST_WEIGHT).collect():  # at most BUCKETS
        model.scores[bucket] = w
    model.rate = _chance_rate(model, texts, sent)
    return model


def chance(scores: list[float], expected: float) -> float:
    """Smallest chance, over r, of r segments that sum to what the best r do, when ``expected``
    segments of score 0 or more occur by chance."""
    best, total = 1.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += s - math.log(expected)
        if total <= r:  # the tail formula holds above
            continue
        tail = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        best = min(best, math.exp(max(tail, -60.0)))
    return best


def toxic_passages(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, passages): score in 0..1 and an array of (start, end, expected, text) for the
    significant segments, in byte positions of the UTF-8 text, with the number of such segments
    expected by chance at most 0.1. Null and empty texts score 0 and have no passage; rows that
    repeat a key are scored each."""
    scores = df.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket
    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, score double, passages array<struct<start: long, end: long, expected: double>>"
    passage = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())])
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scores.value
        for rows, data, offsets in blocks(batches, text):
            words = Words(data, offsets, plain=True)
            values, passages = [], []
            for i, found in enumerate(_all_segments(own, words)):
                n, a = words.counts[i], words.first[i]
                by_chance = own.rate * max(float(n), 1.0)
                expected = [by_chance * math.exp(-s) for _, _, s in found]
                odds = PRIOR_TOXIC / (1 - PRIOR_TOXIC) / chance([s for _, _, s in found], by_chance)
                values.append(odds / (1 + odds) if found else 0.0)
                passages.append(
                    [
                        {"start": words.starts[a + s] - offsets[i], "end": words.ends[a + e - 1] - offsets[i], "expected": x}
                        for (s, e, _), x in zip(found, expected, strict=True)
                        if x <= 0.1
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(values, pa.float64()), pa.array(passages, passage)],
                [key, "score", "passages"],
            )

    return df.select(key, text).mapInArrow(score, schema)
