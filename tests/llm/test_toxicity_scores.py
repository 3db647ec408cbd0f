"""Whole toxicity scores against a plain version, on invented texts."""

import math
import random
import zlib

import numpy as np

from tests.llm.conftest import prose
from wirepulse.llm.common import Words
from wirepulse.llm.toxicity import (
    DEVIATIONS, LEAST_RATE, LEAST_WEIGHT, MOST_WEIGHT, PENALTY, PRIOR, PRIOR_TOXIC, _features, fit_toxicity, is_held_out,
    toxic_passages,
)

BAD = [f"vile{c}slur{c}" for c in "abcdefgh"]


def tables(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        words, toxic = prose(i, rng.randrange(5, 60)).split(), int(i % 4 == 0)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(BAD, k=6)
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, toxic))
    rows += [(None, "vileaslura " * 5), (1000, None), (1001, ""), (1002, "  "), (3, rows[3][1])]
    labels += [(4, 1), (4, 0), (None, 1), (6, None), (5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as key", "3 as toxic")
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def buckets(text):
    """The feature buckets of each word."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _features(Words(data, np.array([0, len(data)]), plain=True)).T.tolist()


def segments(scores):
    """All maximal scoring segments: the best one of a range, then those left and right of it."""
    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (found is None or total > found[2] + 1e-9):
                    found = (i, j + 1, total)
        if found is None:
            return []
        return best(a, found[0]) + [found] + best(found[1], b)
    return best(0, len(scores))


def brute_force(rows, labels):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and not held(i):
            known[i] = max(known.get(i, 0), toxic)
    train = [(set(sum(buckets(t), [])), known[i], t) for i, t in rows if i in known and t is not None]
    totals = [sum(1 for _, y, _ in train if y == c) for c in (0, 1)]
    weights = {}
    for b in set().union(*(f for f, y, _ in train if y)):
        n = [sum(1 for f, y, _ in train if y == c and b in f) + PRIOR for c in (0, 1)]
        delta = math.log(n[1] / (totals[1] + 1)) - math.log(n[0] / (totals[0] + 1))
        w = min(delta - DEVIATIONS * math.sqrt(1 / n[0] + 1 / n[1]), MOST_WEIGHT)
        if w >= LEAST_WEIGHT:
            weights[b] = w

    def word_scores(text):
        out = [max((weights.get(b, 0.0) for b in own), default=0.0) for own in buckets(text)]
        return [x if x > 0 else -PENALTY for x in out]

    clean = [word_scores(t) for _, y, t in train if not y]
    rate = max(LEAST_RATE, sum(len(segments(x)) for x in clean) / max(1, sum(map(len, clean))))
    result = []
    for i, text in rows:
        scores = word_scores(text)
        found = sorted((s for _, _, s in segments(scores)), reverse=True)
        least, total = 1.0, 0.0
        for r, s in enumerate(found, 1):
            total += s - math.log(rate * max(len(scores), 1))
            if total > r:
                tail = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
                least = min(least, math.exp(max(tail, -60)))
        odds = PRIOR_TOXIC / (1 - PRIOR_TOXIC) / least
        result.append((i, odds / (1 + odds) if found else 0.0))
    return result


def test_scores_equal_brute_force(spark):
    rows, labels, docs, known = tables(spark)
    got = toxic_passages(docs, fit_toxicity(docs, known)).select("doc_id", "score").collect()
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = sorted(brute_force(rows, labels), key=order)
    got = sorted(map(tuple, got), key=order)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
    assert sum(s > 0.9 for _, s in got) >= 50


def test_null_ids_and_bounds(spark):
    rows, _, docs, known = tables(spark)
    held = {r.doc_id: r.h for r in docs.select("doc_id", is_held_out(docs.doc_id).alias("h")).collect()}
    assert held[None] is False and set(held.values()) == {True, False}
    few = fit_toxicity(docs, known, most_rows=60)  # a bounded sample of the labels
    assert toxic_passages(docs, few).count() == len(rows)
    nothing = fit_toxicity(docs, known.filter("toxic = 0"))
    assert {r.score for r in toxic_passages(docs, nothing).collect()} == {0.0}
    none = fit_toxicity(docs.filter("false"), known.filter("false"))
    assert toxic_passages(docs.filter("false"), none).count() == 0
