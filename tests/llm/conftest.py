import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    """Invented words, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + WORDS[(x >> 45) % len(WORDS)][:3])
    return " ".join(out)


@pytest.fixture
def documents(spark):
    """Documents with nulls, empty and long texts, exact and near copies, a repeated row and a column
    of a clashing name."""
    base = prose(1, 300)
    near = " ".join(w if i != 150 else "changed" for i, w in enumerate(base.split()))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", "a"), (4, prose(2, 120), "fr", "a"),
        (5, None, None, None), (6, "", "en", "a"), (7, "  \n\t ", "en", "a"), (8, "one two", "en", "b"),
        (9, "One TWO", "en", "b"), (10, prose(3, 6000), "de", "c"), (11, "dup " * 60, "en", "c"),
        (12, prose(4, 90) + " " + base[:400], "en", "a"), (12, prose(4, 90) + " " + base[:400], "en", "a"),
        (13, "éü ß 漢字 \U0001f600 " * 12, "xx", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n int")


@pytest.fixture
def no_documents(documents):
    return documents.filter("false")
