import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from wirepulse.llm.turn_repair import audit_conversations, cheapest_edits, damage, repair_turns

TURNS = "conv_id long, turn long, role string, text string"


def plain_edits(initials, gone, cut):
    """Least (cost, audit) over the states of the grammar, one turn after another."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"0": (0, "")}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for g, (c, a) in list(out.items()):
                for r in "ua":
                    if (g, r) in step:
                        new = (c + 5, a + "I")
                        out[step[g, r]] = min(out.get(step[g, r], new), new)
        return out

    for x, g0, c0 in zip(initials, gone, cut, strict=True):
        after = {}
        for g, (c, a) in inserted(best).items():
            moves = [(g, 2, "D")]
            for r in "uas":
                if not g0 and (g, r) in step and (r == x or r != "s"):
                    moves.append((step[g, r], (r != x) + 5 * c0, "K" if r == x else "R"))
            for to, more, e in moves:
                new = (c + more, a + e)
                after[to] = min(after.get(to, new), new)
        best = after
    return min(v for g, v in inserted(best).items() if g in "0a")


def test_edits_equal_plain_search():
    rng = random.Random(5)
    for _ in range(4000):
        n = rng.randrange(0, 11)
        initials = [rng.choice(rng.choice(["ua", "uas", "uasx", "a", "u"])) for _ in range(n)]
        gone = [rng.random() < 0.2 for _ in range(n)]
        cut = [rng.random() < 0.25 and not g for g in gone]
        assert cheapest_edits(initials, gone, cut) == plain_edits(initials, gone, cut), (initials, gone, cut)


def test_long_conversations():
    rng = random.Random(7)
    for n in (200, 1500):
        initials = ["ua"[i % 2] if rng.random() < 0.97 else rng.choice("uas") for i in range(n)]
        gone = [rng.random() < 0.05 for _ in range(n)]
        cut = [rng.random() < 0.03 and not g for g in gone]
        cost, audit = cheapest_edits(initials, gone, cut)
        assert (cost, audit) == plain_edits(initials, gone, cut)
    assert cheapest_edits(["u"] * 3000, [True] * 3000, [False] * 3000) == (6000, "D" * 3000)


def brute_force(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            fault = zlib.crc32(name.encode()) % 20
            if fault:
                text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                after += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, _, _ in after if t is not None]
        seen, gone, cut, counts = set(), [], [], [0, 0, 0, 0]
        for i, (_, role, text) in enumerate(after):
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults = [not solid, (role, text) in seen, bool(solid) and solid[-1] not in ".!?"]
            seen.add((role, text))
            first = faults.index(True) if True in faults else 3
            if first < 3:
                counts[first] += 1
            gone.append(first < 2)
            cut.append(first == 2)
            counts[3] += i > 0 and after[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = plain_edits([r[:1] for _, r, _ in after], gone, cut)
        parts, position, lead, source = [], 0, 0, iter(after)
        for e in audit:
            _, role, text = ("", "", "") if e == "I" else next(source)
            if e == "D":
                continue
            if position == 0 and e == "K" and role[:1] == "s":
                lead = 1
            parts.append((role if e == "K" else ("user", "assistant")[(position - lead) % 2]) + ":" + text)
            position += 1
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest())
    return out


def random_rows():
    rng = random.Random(11)
    texts = ["Fine.", "So?", "cut off", "", "  \n", None, "A. B", "Né!  \n", "." * 3, "x.y", "Fine."]
    rows = []
    for conv in [*range(150), None]:
        turn = rng.choice([0, -3, 10**12])
        for _ in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 0, 3])
    return rows


def test_audits_equal_brute_force(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as audit", "1 as part", "2 as dropped", "3 as counts").repartition(4)
    want = brute_force(rows)
    for batch in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.conv_id: tuple(r)[1:] for r in audit_conversations(damage(df)).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_repaired_turns_alternate(spark):
    rows = random_rows()
    rows.append((999, 0, "user", "long text. " * 100_000))
    damaged = damage(spark.createDataFrame(rows, TURNS))
    digests = {r.conv_id: r.repaired_sha256 for r in audit_conversations(damaged).collect()}
    turns = {}
    for r in repair_turns(damaged).orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, h in digests.items():
        own = turns.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == h


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert audit_conversations(damage(none)).count() == 0 and repair_turns(damage(none)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = damage(spark.createDataFrame([(dropped, 0, "user", "Gone.")], TURNS))
    got = audit_conversations(df).first()
    assert tuple(got) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    only_null = spark.createDataFrame([(None, None, None, None)] * 2, TURNS).withColumn("n", F.lit(1))
    assert audit_conversations(damage(only_null)).count() == 1
