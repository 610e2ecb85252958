import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    base = "the cat sat on the mat and then it ran to the door of the old house by the sea with a hat " * 4
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, "a"), (3, None, "en", None), (4, "", "en", "b"), (5, " \n\t ", "en", "b"), (None, base, "en", "b"),
        (None, None, None, None), (6, long, "fr", "c"), (7, "short text", "fr", "c"), (8, base.replace("cat", "dog", 1), "en", "c"), (9, "\u00e9\U0001f600\x00 <|endoftext|> x", "de", "c"),
    ]
    d = spark.createDataFrame([(*r, k, "z", 1.0) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score string, rep double")
    return d


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
