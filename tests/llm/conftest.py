import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "zeta", "eta,", "theta.", "iota", "kappa"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [text(rnd.randint(60, 200)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "s", 1), (101, base[3].replace(" ", "\n"), "en", "s", 1), (102, base[3] + " ", "en", "s", 1), (5, base[5], "en", "s", 1), (5, base[5], "en", "s", 1)]
    rows += [(200, None, "en", "s", None), (201, "", None, None, 0), (202, " \t\n ", "en", "s", 4), (None, base[7], "en", "s", 1), (None, None, None, None, None)]
    rows += [(300, text(60_000), "en", "s", 1), (301, "x" * 200_000, "en", "s", 1), (302, "a <|endoftext|> b<|endoftext|>", "en", "s", 1), (303, "one", "en", "s", 1), (304, "one two", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("fingerprint", "keep_id", "score", "row", "label_id", "row_fp", "row_text", "w", "n_tokens", "block")}).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 0, 0), (None, 1, 0), (7, None, None), (99_999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
