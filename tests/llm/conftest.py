import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, start string, _text string"
LONG = " ".join(f"word{i % 977} of {i}" for i in range(40_000))
ROWS = [
    (1, "Some plain words in a row, and some more of them.", "en", "b"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", None, "a"),
    (5, LONG, "en", "a"), (6, "same text here, said twice over", "fr", None), (6, "same text here, said twice over", "fr", None),
    (None, "no id at all, but a password = hunter2hunter2", "de", "b"), (None, None, None, None), (7, "x" * 50_000, "en", "c"),
    (8, "same text here, said twice over", None, "c"), (9, "<|endoftext|> token =İ café é \x00 ok", "es", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, missing ids, and columns whose names the operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "z", "t", "u") for r in ROWS], DOCS)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
