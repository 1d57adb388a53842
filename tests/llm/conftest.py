import pytest


@pytest.fixture
def odd(spark):
    """Rows with nulls, empties, a long text, ties and repeats, and columns
    whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(0, "the quick brown fox jumps over the lazy dog by the river", "en"), (1, None, None), (2, "", "en"),
            (3, " \n\t ", "fr"), (4, long, "en"), (5, long, "de"), (6, "..., 123 !!", "es"), (None, "a lone row", "en"),
            (7, "same", "fr"), (7, "same", "fr"), (8, "The Quick brown fox jumps over the lazy dog by the river", None),
            (9, "été à la plage où nous étions", "fr")]
    return spark.createDataFrame([(*r, "x", 1, "y", 2.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp string, score double")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
