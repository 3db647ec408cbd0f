import zlib

import numpy as np
import pytest

from wirepulse.llm.checksums import crc32c, masked
from wirepulse.llm.packing import SumOfSquares, pack_documents
from wirepulse.llm.queries import vocabulary
from wirepulse.llm.records import read_index, read_records, read_some, write_records
from wirepulse.llm.tokens import tokenizer
from wirepulse.session import fresh_path


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.encode_special_tokens = True
    return lambda text: np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


TRICKY = [
    "a.b, c,. I'm They'll", "Été, é. H̱ x̱, foö., 123.5, ab1, ÀB. İx, ΑΣ. ﬁ", "don't, it's. A'S,b,c", "", " ",
    "<|endoftext|>, <|ENDOFTEXT|>.", "x y z, w", "漢字。かな, ...,,, a....",
]


def test_word_ids_are_the_librarys(encode):
    import pyarrow as pa

    from wirepulse.llm.common import text_bytes

    ids, ends = tokenizer(vocabulary()).encode(*text_bytes(pa.array(TRICKY * 2)))
    for i, text in enumerate(TRICKY * 2):
        assert ids[ends[i] : ends[i + 1]].tolist() == encode(text)[:-1].tolist()


def test_pieces_cover_every_document(spark, documents, no_documents, encode):
    pieces = pack_documents(documents.withColumnRenamed("n", "start"), vocabulary()).toPandas()
    texts = documents.toPandas()
    left = {i: encode(t) for i, t in zip(texts.doc_id, texts.text, strict=True)}
    for p in pieces.itertuples():
        ids = left[p.doc_id]
        own = ids[p.start : p.start + p.length]
        assert p.doc_tokens == len(ids) and list(p.ids) == own.tolist()
        assert p.ids_crc32 == zlib.crc32(own.tobytes())
    assert pieces.length.sum() == sum(len(left[i]) for i in texts.doc_id)
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    full = pieces.groupby("sequence_id").length.sum()
    assert (full < 2048).sum() <= documents.rdd.getNumPartitions()
    assert pack_documents(no_documents, vocabulary()).count() == 0


def test_sum_of_squares_choice():
    packer = SumOfSquares(10)
    levels = lambda: {i: n for i, n in enumerate(packer.counts.tolist()) if n}
    for n in (4, 4, 4):  # the second joins the first: 1 is less than 4; the third fits nowhere
        assert packer.place((0, 0, n)) is None
    assert levels() == {4: 1, 8: 1}
    assert packer.place((1, 0, 6)) == [(0, 0, 4), (1, 0, 6)]
    packer.place((2, 0, 4))
    packer.place((3, 0, 4))  # one level with two windows is less than levels with two and one
    assert levels() == {8: 2}
    assert sorted(sum(p[2] for p in w) for w in packer.finish()) == [6, 10]


def test_checksums():
    data = np.frombuffer(b"123456789" + bytes(32) + b"abc", np.uint8)
    got = crc32c(data, np.array([0, 9, 41, 3]), np.array([9, 32, 3, 0]))
    assert [hex(x) for x in got] == ["0xe3069283", "0x8a9136aa", "0x364b3fb7", "0x0"]
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def test_round_trip(spark, documents, no_documents, encode):
    path = fresh_path(spark, "records")
    files = write_records(documents, path, vocabulary()).collect()
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=lambda r: (r[0], r[1] or ""))
    ids = [encode(t) for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)])
    got = sorted(read_records(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got] == [
        (k, s, len(x), zlib.crc32(x.tobytes()), x.tolist()) for (k, _), s, x in zip(rows, starts, ids, strict=False)
    ]
    file = max(files, key=lambda f: f.docs).file
    _, index = read_index(path, file)
    order = list(range(len(index)))[::-1]
    assert [len(x) for x in read_some(path, file, order)] == index[order, 2].tolist()
    empty = fresh_path(spark, "records")
    assert write_records(no_documents, empty, vocabulary()).count() == 0
    assert read_records(spark, empty).count() == 0


def test_damage_is_found(spark, documents):
    path = fresh_path(spark, "records")
    file = write_records(documents.filter("doc_id = 4"), path, vocabulary()).first().file
    with open(f"{path}/{file}.records", "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        read_records(spark, path).collect()
