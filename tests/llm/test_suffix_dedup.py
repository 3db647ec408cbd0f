import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from wirepulse.llm.common import whole_groups
from wirepulse.llm.suffix_dedup import _entries, merged_runs, remove_repeats


def brute_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        runs = merged_runs([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1])
        ends = [0, *(x for r in runs for x in r), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))
        out.append((len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=200, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = remove_repeats(df, length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = [(k, *x) for (k, _), x in zip(rows, brute_force([t for _, t in rows], length), strict=True)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("length", [40, 200])
def test_passages_edits_and_periodic_texts(spark, length):
    rng = random.Random(length)
    passage, rows = prose(50, 60), []
    for i in range(25):
        words = prose(i % 9, 200).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = f"e{rng.random()}"
        at = rng.randrange(200)
        rows.append((i, " ".join(words[:at] + [passage[rng.randrange(9) :]] * (i % 3) + words[at:])))
    rows += [(100, "ab" * 400), (101, "a" * 700), (102, prose(70, 40) * 2), (103, None), (104, ""), (105, passage[:length])]
    rows += [(106, "éß漢" * 100), (107, passage[:200]), (107, passage[:200])]
    check(spark, rows, length)


def test_frequent_anchors(spark):
    """A passage in so many different contexts that one task sums it."""
    passage = prose(60, 45)
    rows = [(i, f"{prose(i + 300, 12)} {passage} {prose(i + 900, 12)}") for i in range(700)]
    check(spark, rows)
    check(spark, rows, parts=1)


def test_frequent_phrases_shorter_than_a_window(spark):
    """Anchors in very many contexts, few of which share a window, on either side of the phrase."""
    phrase, before, behind = prose(61, 8), prose(62, 14), prose(63, 14)
    rows = [(i, f"{prose(i + 300, 9)} {phrase} {prose(i + 1900, 9)} {prose(i + 300, 14)}") for i in range(900)]
    rows += [(1000 + i, f"{prose(i + 3000, 9)} {phrase} {behind}") for i in range(3)]
    rows += [(2000 + i, f"{before} {phrase} {prose(i + 4000, 14)}") for i in range(3)]
    rows += [(3000 + i, f"{prose(i + 5000, 3)} {before[-80:]} {phrase} {behind[:90]} {prose(i + 6000, 9)}") for i in range(300)]
    check(spark, rows, parts=2)
    check(spark, rows, length=120, parts=1)


def test_rows_without_ids_and_clashing_columns(spark):
    text = prose(64, 60)
    rows = [(None, text), (None, text), (None, prose(65, 60)), (1, f"{prose(66, 20)} {text}"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as kind", "2 as _spans", "3 as kept")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(df).collect())
    n = len(text)
    assert got == [(0, 0, 0), (0, len(prose(65, 60)), 0), (0, n, n), (0, n, n), (1, n + 1 + len(prose(66, 20)), n)]


def test_documents_and_whole_characters(spark, documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(spark, rows)
    kept = remove_repeats(documents, whole_characters=True, columns=("lang", "n")).collect()
    assert len(kept) == len(rows) and {r.n for r in kept} == {7}
    by = {r.doc_id: r.kept for r in kept}
    assert by[4] == prose(2, 120) and by[5] == "" and by[1] == ""
    assert remove_repeats(no_documents).count() == 0


def test_anchors_are_spread_over_all_buckets():
    data = np.random.default_rng(7).integers(97, 123, 400_000, dtype=np.uint8)
    offsets = np.arange(0, 400_001, 4_000)
    anchors = _entries(np.arange(100), data, offsets, 200)["anchor"]
    counts = np.bincount((anchors >> np.uint64(60)).astype(np.int64), minlength=16)
    assert counts.sum() > 3_000 and counts.max() < 1.5 * counts.mean()


@pytest.mark.parametrize("most", [1, 64, 400, 1 << 20])
def test_sorted_rows_come_in_parts_of_whole_groups(most):
    rng = random.Random(3)
    keys = sorted(rng.choice([-9, 0, 2, 5, *range(100, 160)]) for _ in range(900)) + [500] * 300
    rows = pa.table({"k": pa.array(keys, pa.int64()), "n": list(range(1200))})
    batches = [b for at in (0, 7, 300, 301, 1150) for b in rows.slice(at, {0: 7, 7: 293, 300: 1, 301: 849, 1150: 50}[at]).to_batches()]
    parts = [pa.Table.from_batches(x) for x in whole_groups(iter(batches), "k", most)]
    assert pa.concat_tables(parts).to_pylist() == rows.to_pylist()
    ends = [(p["k"][0].as_py(), p["k"][-1].as_py()) for p in parts]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    largest = 16 * max(Counter(keys).values())
    assert all(p.nbytes <= 2 * most + largest for p in parts) and list(whole_groups(iter([]), "k", most)) == []
