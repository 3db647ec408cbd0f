"""The whole pipeline against a brute-force version of its five stages on a small table."""

import shutil
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_ngram_join import brute_force as components
from tests.llm.test_rules import WORD, measures
from wirepulse.llm.oracles import DECONTAMINATION
from wirepulse.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def without_rejects(rows):
    norm = lambda line: tuple(WORD.findall(line.lower()))
    hosts, lines = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text)
        for line in text.split("\n"):
            lines[host, norm(line)].add(text)
    common = {k for k, v in lines.items() if k[1] and len(v) > 20 and len(v) > min(0.05 * len(hosts[k[0]]), 1000)}
    out = []
    for key, text, host in rows:
        parts = text.split("\n")
        n, lost = measures(text)[0], sum(len(norm(x)) for x in parts if (host, norm(x)) in common)
        if not measures(text)[-1] and not (lost and (n - lost < 20 or n - lost < 0.3 * n)):
            out.append((key, "\n".join(x for x in parts if (host, norm(x)) not in common)))
    return out


def without_repeats(rows, length=200):
    raws = [text.encode() for _, text in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (key, text), raw in zip(rows, raws, strict=True):
        cut = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                cut[i : i + length] = True
        ends = np.cumsum([0, *(len(c.encode()) for c in text)])
        left = "".join(c for c, a, b in zip(text, ends[:-1], ends[1:], strict=True) if not cut[a:b].all())
        if left.strip(" "):
            out.append((key, left))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    line, passage = prose(7, 8), prose(8, 45)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    own = [f"{prose(i + 100, 40)}\n{line}\n{passage if i < 3 else prose(i + 200, 30)}" for i in range(25)]
    own += [f"{own[4]} near", f"{prose(300, 12)}\n{line}\n{prose(301, 4)}"]
    more = {"doc_id": range(10**6, 10**6 + len(own)), "text": own, "lang": "en", "source": "h", "n_chars": [*map(len, own)]}
    docs = pd.concat([docs, pd.DataFrame(more)], ignore_index=True)
    spark.createDataFrame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path)

    rows = without_rejects([(k, t or "", h or "") for k, t, h in docs[["doc_id", "text", "source"]].itertuples(index=False)])
    first = {k for k, _, c in components(rows, 5, 80) if k == c}
    rows = without_repeats([r for r in rows if r[0] in first])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    leaks = {r[0] for r in con.execute(DECONTAMINATION).fetchall()}
    texts = {k: t for k, t in rows if k not in leaks}
    assert leaks and 10**6 in texts and line not in texts[10**6] and not {10**6 + 25, 10**6 + 26} & set(texts)

    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(vocabulary()).encode_batch(list(texts.values()), add_special_tokens=False)
    ids = {k: np.array([*e.ids, 1], "<u4") for k, e in zip(texts, encoded, strict=True)}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(ids)
    for key, part in pieces.sort_values("start").groupby("doc_id"):
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids[key])
        for p in part.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[key][p.start : p.start + p.length].tobytes())
