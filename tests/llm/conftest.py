import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empties, ties, repeated rows, a very long text, and extra columns whose names clash with outputs."""
    base = " ".join(f"word{k} of the text" for k in range(40))
    rows = [
        (1, base, "x"), (2, base, "x"), (3, base + " more", "x"), (3, base + " more", "x"), (4, None, None), (5, "", "x"), (6, "One", "x"), (7, "one", "x"),
        (None, base, "x"), (8, "long " * 60_000, "x"), (9, "\x00\t\n", "x"), (10, "Ünï çödé 日本 " * 5, "x"),
    ]
    return spark.createDataFrame([(i, t, s, 0.5, [1]) for i, t, s in rows], "doc_id long, text string, source string, score double, hits array<int>")
