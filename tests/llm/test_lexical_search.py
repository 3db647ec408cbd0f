import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.conftest import prose
from wirepulse.llm.lexical_search import build_automaton, scan, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(documents, items, top):
    counts = [(k, Counter(terms(t))) for k, t in documents]
    n_docs = sum(1 for _, c in counts if c)
    n_terms = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    out = []
    for i, words in wanted.items():
        scored = []
        for k, c in counts:
            m = 50 + 50 * c.total() * n_docs // max(n_terms, 1)
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in words if c[t]
            )
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        out += [(i, r, k, -s) for r, (s, _, _, k) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_terms_only():
    own = build_automaton([(1, "ab"), (1, "b"), (2, "ab"), (2, "é"), (None, "漢字")], pa.int64())
    texts = ["ab b.ab-abb", "", "é é漢字", "漢字", "b"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    lengths, doc, term, tf = scan(own, data, offsets)
    names = ["ab", "b", "é", "漢字"]
    assert lengths.tolist() == [4, 0, 2, 1, 1]
    assert sorted((d, names[t], n) for d, t, n in zip(doc, term, tf, strict=True)) == [
        (0, "ab", 2), (0, "b", 1), (2, "é", 1), (3, "漢字", 1), (4, "b", 1),
    ]


def test_scores_equal_brute_force(spark, documents):
    items = [(1, "Alphaalp betabet, GAMMA one two"), (2, "éü 漢字! dup"), (3, None), (4, ""), (5, prose(3, 400)), (None, "two"), (1, "two")]
    texts = documents.select("doc_id", "text").collect() + [(None, "two one"), (None, "TWO"), (50, "a " * 300_000 + "two")]
    docs = spark.createDataFrame([tuple(r) for r in texts], "doc_id long, text string").selectExpr("*", "1 as score", "2 as item_id", "'x' as term")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as doc_id", "'r' as rank")
    for top, pairs in ((3, 1000), (50, 1000), (2, 20)):
        assert rows(search(docs, bench, top, most_pairs=pairs)) == brute_force(texts, items, top)
    assert search(docs.filter("false"), bench).count() == 0
    assert search(docs, bench.filter("false")).count() == 0
    named = bench.selectExpr("concat('n', item_id) as item_id", "text")
    want = brute_force(texts, [(f"n{i}" if i else None, t) for i, t in items], 4)
    assert rows(search(docs, named, 4)) == want


def test_ties_and_many_documents(spark):
    texts = [(i * 7 % 1000, "same words here" if i % 3 else f"same {i}") for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(5)
    items = [(i, w) for i, w in enumerate(["words", "same words", "here same", "none"])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert rows(search(docs, bench, 50)) == brute_force(texts, items, 50)
