import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from wirepulse.llm.toxicity import chance, fit_toxicity, segments, toxic_passages
from wirepulse.llm.warc import parse_record, read_index, read_page, read_warc, write_warc
from wirepulse.session import fresh_path


def all_maximal(scores):
    """Maximal scoring segments by their definition: best segment, then the same left and right."""

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] + 1e-12):
                    best = (i, j + 1, total)
        if best is None:
            return []
        return [*split(lo, best[0]), best, *split(best[1], hi)]

    return split(0, len(scores))


@pytest.mark.parametrize("seed", range(20))
def test_segments(seed):
    rng = np.random.default_rng(seed)
    scores = rng.choice([2.3, 1.1, -0.7, -0.7, -0.9, -2.05], 40) + rng.random(40) / 1000
    got = segments(scores)
    assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in all_maximal(scores)]


def test_chance_falls_with_score_and_number():
    assert chance([], 1.0) == 1.0
    assert chance([6.0], 1.0) < chance([4.0], 1.0) < 0.2
    assert chance([4.0, 4.0], 1.0) < chance([4.0], 1.0) < chance([4.0], 3.0)


def test_held_out_toxic_documents_are_found(spark):
    bad = ["vile", "scumbag", "wretch"]
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 60).split()
        toxic = i % 6 == 0
        if toxic:
            words[10:13] = bad
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "vile " * 5000), (3, rows[3][1])]
    labels += [(1000, 1), (1001, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'toxic' as score")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxic_passages(docs, model).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [i for i in held if (got[i].score >= 0.3) != (i % 6 == 0)]
    assert len(wrong) <= 1 and got[1000].score == got[1001].score == 0 and got[1002].score > 0.9
    text = dict(rows)
    for i in held:
        if i % 6 == 0:
            p = got[i].passages[0]
            assert "scumbag" in text[i].encode()[p.start : p.end].decode()
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = fit_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxic_passages(docs, none).collect()} == {0.0}


def test_archive_round_trip(spark, monkeypatch):
    copy = "<p>" + "copy é " * 300
    rows = [(i, f"http://h/{i}", copy) for i in range(40)] + [(50 + i, f"http://s/{i}", "short") for i in range(3)]
    rows += [(60, None, None), (61, "http://a\nb", ""), (62, "http://l", "x\r\n\r\nWARC/1.1 " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as _n").repartition(3)
    path = fresh_path(spark, "warc")
    files = write_warc(df, path).collect()
    assert sum(f.records for f in files) == len(rows)
    got = {r.page_id: r for r in read_warc(spark, path).collect()}
    payloads = {k: (h or "").encode() for k, _, h in rows}
    for key, data in payloads.items():
        first = max(k for k, d in payloads.items() if d == data)
        again = len(data) >= 1000 and key != first
        assert got[key].payload_bytes == len(data) and got[key].payload_digest == hashlib.sha1(data).hexdigest()
        assert (got[key].record_type, got[key].refers_to) == (("revisit", first) if again else ("response", None))
    # The index leads to single records, and plain decompressors read the file.
    import zstandard

    for f in files:
        with open(f"{path}/{f.file}.warc.zst", "rb") as source:
            data = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
        for page, frame, at, length in read_index(path, f.file):
            fields, block = read_page(path, f.file, frame, at, length)
            assert fields["WARC-Record-ID"] == f"<urn:page:{page}>" and len(block) == int(fields["Content-Length"])
        at, types = 0, Counter()
        while at < len(data):
            fields, _, at = parse_record(data, at)
            types[fields["WARC-Type"]] += 1
        assert sum(types.values()) == f.records
    assert write_warc(df.filter("false"), fresh_path(spark, "warc")).count() == 0
