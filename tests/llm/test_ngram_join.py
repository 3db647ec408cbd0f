import random
import re

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import prose
from wirepulse.llm.ngram_join import (
    JoinRule, _bitmap, _mixed_groups, _most_common, open_groups, qualifying, similarity_components,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, size, percent):
    """Component of each row's set by comparing all pairs."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        smallest[root(i)] = min(key, smallest.get(root(i), key))
    return sorted((key, len(sets[i]), smallest[root(i)]) for i, (key, _) in enumerate(rows))


def check(spark, rows, size, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = similarity_components(df, JoinRule(size, percent)).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_edits_chains_and_shared_passages(spark, size, percent):
    rng = random.Random(size)
    rows, passage = [], prose(99, 150)
    for base in range(12):
        words = prose(base, rng.choice([4, 9, 15, 40, 120, 260])).split()
        for _ in range(rng.randint(1, 8)):
            for _ in range(rng.randint(0, 2)):  # each copy is an edit of the one before: chains
                words[rng.randrange(len(words))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, passage + " " + prose(1000 + i, 250)) for i in range(30)]
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "a b", "A  B", "a b c", "x " * 50, "x " * 90])]
    rng.shuffle(rows)
    check(spark, rows, size, percent)


def test_links_that_no_pivot_has(spark):
    """Texts that grow word by word: most links are between sets that agree with a common pivot but aren't linked
    with it, so that only the second round of comparisons finds them."""
    rows = []
    for n in (*range(1, 60), 100, 190, 200, 380, 399, 400):
        base = [f"q{n}_{j}" for j in range(n + 2)]
        for more in range(n // 9 + 2):
            rows.append((len(rows), " ".join(base + [f"z{len(rows)}_{j}" for j in range(more)])))
    check(spark, rows, 3, 90)


def test_rows_of_a_shared_passage_are_not_pairs(spark):
    """Sets that agree on sections of one passage, each also with a set of its own: all of them meet, in
    rows of their number."""
    k = 150
    shared = [(sig, 1000 + i, 1000) for sig in (1, 2, 3) for i in range(k)]
    own = [(100 + i, doc, i) for i in range(k) for doc in (i, 1000 + i)]
    agreed = spark.createDataFrame(shared + own, "sig long, doc long, pivot long")
    docs = [(d,) for d in (*range(k), *range(1000, 1000 + k))]
    comps = spark.createDataFrame([(d, d) for (d,) in docs], "doc long, comp long")
    tokens = spark.createDataFrame([(d, 300) for (d,) in docs], "doc long, n long")
    groups = {}
    found = _mixed_groups(agreed, comps, tokens, JoinRule()).collect()
    for r in found:
        groups.setdefault(r.group, (set(), set()))[r.query].add(r.doc)
    assert len(found) <= 6 * k
    met = {frozenset((q, m)) for members, queries in groups.values() for q in queries for m in members}
    assert all(frozenset((1000 + i, 1000 + j)) in met for i in range(k) for j in range(i))
    assert all(frozenset((i, 1000 + i)) in met for i in range(k))


def test_a_large_group_of_near_copies(spark):
    base = prose(5, 200).split()
    rows = [(i, " ".join(w if j not in (i, i * 7 % 200) else f"n{i}" for j, w in enumerate(base))) for i in range(200)]
    check(spark, [*rows, (500, prose(6, 200))], 3, 90)


def test_documents(spark, documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = similarity_components(documents, JoinRule(3, 90)).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 3, 90)
    assert similarity_components(no_documents, JoinRule(3, 90)).count() == 0


def test_a_null_key_has_no_component(spark):
    df = spark.createDataFrame([(None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert {tuple(r) for r in similarity_components(df).collect()} == {(None, 2, None), (2, 2, 2)}


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sizes_meet_in_a_scheme(percent):
    rule = JoinRule(3, percent)
    for a in range(1, 400):
        for b in range(a, a * 100 // percent + 1):
            needed = rule.needed(a, b)
            assert rule.linked(needed, a, b) and not rule.linked(needed - 1, a, b)
            shared = {x for x in rule.schemes(a)} & set(rule.schemes(b))
            # Some scheme of both has more sections than they can differ in, and spare ones.
            assert any(sections - (a + b - 2 * needed) > spare for _, sections, spare in shared)


def test_bitmaps_bound_the_overlap_and_rule_out_strangers():
    rng = np.random.default_rng(3)
    rule = JoinRule(5, 80)
    for n in (0, 1, 30, 33, 500, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for m in {n // 2, n * 9 // 10, n}:
            b = np.unique(np.concatenate([a[:m], rng.integers(0, 1 << 63, n // 8, np.uint64)]))
            bound = _most_common(_bitmap(a), len(a), _bitmap(b), len(b))
            assert m <= bound <= min(len(a), len(b))
        stranger = rng.integers(0, 1 << 63, n, np.uint64)
        if n >= 500:
            assert _most_common(_bitmap(a), n, _bitmap(stranger), n) < rule.needed(n, n)


def test_groups_of_several_widths_open_only_what_may_link():
    rng = np.random.default_rng(4)
    rule = JoinRule(5, 80)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    near = [np.unique(np.append(base[i:], rng.integers(0, 1 << 63, 5, np.uint64))) for i in range(0, 50, 5)]
    far = [np.unique(rng.integers(0, 1 << 63, k, np.uint64)) for k in (20, 60, 240, 300, 520, 2000)]
    texts = [np.unique(base), *near, *far]
    rows = [
        {"doc": i, "comp": i, "query": query, "n": len(t), "tokens": t.tobytes()}
        for i, t in enumerate(texts) for query in (True, False)
    ]
    maps = [{**r, "tokens": _bitmap(np.frombuffer(r["tokens"], np.uint64)).tobytes()} for r in rows]
    kept = qualifying(pd.DataFrame(maps), rule)
    assert {d for d, _, _ in kept} == set(range(1 + len(near)))
    parts = [{i} for i in range(len(texts))]
    for u, v in open_groups(pd.DataFrame(rows), rule):
        a, b = (next(p for p in parts if x in p) for x in (u, v))
        parts = [p for p in parts if p not in (a, b)] + [a | b]
    assert sorted(map(len, parts)) == [1] * len(far) + [1 + len(near)]
