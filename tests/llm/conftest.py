import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
        if extra:
            for name in ("row", "id", "key", "node", "size", "seeds", "part", "_key"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties, and one long text."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    return [
        (1, "The cat sat on the mat and the dog lay by the door of the old house."),
        (1, "The cat sat on the mat and the dog lay by the door of the old house."),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (None, "A text of nobody."),
        (5, long),
        (6, "!!! 123 ... \U0001f600"),
        (7, "x" * 5000),
    ]
