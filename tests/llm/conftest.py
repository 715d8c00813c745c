import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns whose names the operators might use."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line here", "en", "a", 10),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line here", "en", "a", 10),
        (2, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa!\n\nthird", "en", None, None),
        (3, None, None, "b", None),
        (None, "no id but some text with more than ten words in it, so it passes all the rules", None, None, None),
        (5, "", "en", "b", 0),
        (6, LONG, "en", "b", len(LONG)),
        (7, " \t\n\x0b\x0c\r ", "xx", "c", 7),
        (8, "\x1f\u00a0\u2003é日本 😀 </s> <|endoftext|>  double  space", "xx", "c", 1),
        (9, "one two three four five six seven eight nine ten eleven\none two three four five six seven eight nine ten eleven", "en", "a", 1),
    ]
    extra = "kept string, key long, rank long, c string, size double, s string, _k1 long, n string, a long, b long, d long, text_ string"
    values = ["x", 1, 2, "y", 0.5, None, 3, "z", 4, 5, 6, "t"]
    return spark.createDataFrame([(*r, *values) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
