import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirepulse.llm.chat_format import (
    END, START, canonical_json_turns, canonical_turns, chat_digests, chat_records, escaped, format_turns, read_piece,
    select_layout, unescaped,
)

TURNS = "conv_id long, turn long, role string, text string"
HARD = ["</s>", "[INST]", START, END, "<\\|im_end|>", "<\\\\/s>", "<<SYS>>", "<<</SYS>>>", "\\", "a\nb", "", "é漢\U0001f600"]


def test_escapes_are_reversible(spark):
    texts = HARD + [a + b for a in HARD for b in HARD]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).collect()
    for r in rows:
        assert unescaped(r.e) == r.t
        assert not any(c in r.e for c in ("</s>", "[INST]", START, END, "<<SYS>>"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[\\/s>|INST]im_end", max_size=30))
def test_unescape_leaves_texts_without_markers_alone(text):
    """The Python form of the column expression, on texts made of the pieces of markers."""
    import re

    from wirepulse.llm.chat_format import _PLAIN

    assert unescaped(re.sub(_PLAIN, r"\1\\\2\3", text)) == text


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_force(rows):
    """From plain rows, without the template."""
    out = {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=order):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"),
            digest("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()
    }


def test_round_trip_of_hard_turns(spark):
    rows = [(1, i, ("user", "assistant", "system", "a\nb\\n", "</s>")[i % 5], t) for i, t in enumerate(HARD)]
    rows += [(2, None, None, None), (2, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit(1)).withColumn("loss_start", F.lit("x"))
    pieces = format_turns(canonical_turns(df, "conv_id"))
    for r in pieces.collect():
        role, text = read_piece(r.piece)
        assert unescaped(r.piece[r.loss_start : r.loss_end]) == (text if role == "assistant" else "")
    got = {r.conv_id: tuple(r)[1:5] for r in chat_digests(pieces).collect()}
    assert got == brute_force(rows)
    whole = {r.conv_id: r for r in chat_records(pieces).collect()}
    assert whole[3].formatted == f"{START}user\nsame{END}\n" * 2 and not whole[3].loss
    learnt = "".join(unescaped(whole[1].formatted[a:b]) for a, b in whole[1].loss)
    assert learnt == "".join(t for _, _, role, t in rows[: len(HARD)] if role == "assistant")
    lengths = {r.conv_id: r.formatted_chars for r in chat_digests(pieces).collect()}
    assert lengths == {c: len(r.formatted) for c, r in whole.items()}


def test_conversations_follow_one_another_across_batches(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}") for c in range(50) for t in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: tuple(r)[1:5] for r in chat_digests(format_turns(spark.createDataFrame(rows, TURNS))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_force(rows)


def test_layouts_of_tables(spark):
    want = [(1, "user", "Q"), (1, "assistant", "A")]

    def turns(df):
        got = canonical_turns(df, "id").orderBy("id", "turn").collect()
        return [(r.id, r.role, r.text) for r in got]

    plain = spark.createDataFrame([(1, "Q", "A")], "id int, prompt string, response string")
    assert turns(plain) == want and turns(plain.withColumn("turn", F.lit(3))) == want
    assert turns(plain.withColumnRenamed("response", "completion")) == want
    assert turns(plain.selectExpr("id", "prompt as question", "response as answer")) == want
    wide = plain.selectExpr("id", "prompt as instruction", "response as output", "'more' as input", "cast(null as string) as system")
    assert turns(wide) == [(1, "user", "Q\n\nmore"), (1, "assistant", "A")]
    nested = spark.createDataFrame([(1, [("human", "Q"), ("gpt", "A"), (None, None)]), (2, None), (3, [])], "id int, conversations array<struct<from: string, value: string>>")
    assert turns(nested) == [*want, (1, "", "")]
    with pytest.raises(ValueError):
        canonical_turns(plain.select("id"), "id")
    assert chat_digests(format_turns(canonical_turns(plain.filter("false"), "id"), "id"), "id").count() == 0


def test_layouts_of_mixed_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}], "meta": {"x": [1]}},
        {"prompt": "Q", "response": "A", "system": None}, {"instruction": "Q", "input": "I", "output": "A"},
        {"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]}, {"other": 1}, [1],
    ]
    raw = [json.dumps(r) for r in records] + ["{broken", None, ""]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, body string")
    got = {}
    for r in canonical_json_turns(df, "id", "body").orderBy("id", "turn").collect():
        got.setdefault(r.id, []).append((r.layout, r.role, r.text))
    assert [x[0][0] for _, x in sorted(got.items())] == ["messages", "prompt and response", "instruction", "from and value"] + [None] * 5
    assert all([t[1:] for t in got[i]] == [("user", "Q"), ("assistant", "A")] for i in (0, 1, 3))
    assert got[2][0][2] == "Q\n\nI" and got[8] == [(None, None, None)]
    assert select_layout({"prompt", "completion", "response", "x"}).name == "prompt and response"
