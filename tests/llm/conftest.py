import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k0 long, id string, v string, n_lines string, score string"
LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(60_000))


def texts():
    """Ids and texts with every odd case: null, empty, blank, one word, ties, repeated rows, no id, a very long text."""
    base = " ".join(f"alpha{i % 17} beta{i % 13} gamma{i}" for i in range(60))
    near = base.replace("gamma59", "omega59")
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, base), (7, base), (8, near), (8, near), (9, LONG),
            (None, base), (None, None), (10, "Ünïcödé – 世界 naïve\x01 a  b\tc"), (11, "x" * 5000), (12, "12345 !!! ***"), (13, near + " tail"),
            (14, "<|endoftext|> the <|startoftext|> end")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "s", 0, "r", 1, "x", "y", "z", "w") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
