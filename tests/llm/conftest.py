import pytest

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(120_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "en"),
    (5, LONG, "de"),
    (6, "alpha beta gamma delta epsilon zeta", "en"),
    (6, "alpha beta gamma delta epsilon zeta", "en"),
    (None, "alpha beta gamma delta epsilon zeta", None),
    (None, None, None),
    (7, "1234 5678 !!", "fr"),
]
#: Names that operators use within.
CLASHING = ["n", "key", "score", "rep", "t", "c", "comp", "kept", "failed", "n_words", "y", "shard", "slot", "ids", "passages", "rejected_id", "n_values"]


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'s' as source", "coalesce(length(text), 0) as n_chars", *[f"'x' as {c}" for c in CLASHING])


@pytest.fixture
def none(odd):
    return odd.limit(0)
