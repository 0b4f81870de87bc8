import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """documents of (doc_id, text) pairs, or (doc_id, text, source), with the other columns filled in."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls in every column, empty and blank texts, one long text, ties, repeated rows."""
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(40_000))
    rows = [(None, None, None), (1, None), (2, ""), (3, "  \n "), (4, "One plain sentence of some words."), (4, "One plain sentence of some words."), (5, "One plain sentence of some words."), (6, long), (7, long), (None, "text without a number")]
    return documents(rows)
