import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
EXTRA = {"size": "7", "score": "x", "rank": "1", "shard": "2", "n": "3", "id": "4", "v": "5", "bucket": "6", "copies": "8", "component": "9", "part": "10", "held_out": "no", "_row": "r", "n_tokens": "11"}


@pytest.fixture(scope="session")
def odd(spark):
    """Null, blank, odd, long, equal and repeated rows."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 997} of{i}" for i in range(20_000))
    texts = [
        (5, "The cat sat on the mat and then it slept", "a"),
        (3, None, None),
        (4, "", "a"),
        (7, " \t\n\x0b ", "b"),
        (2, "one two", "b"),
        (9, "ONE two", None),
        (1, long, "c"),
        (8, long + " end", "c"),
        (6, "The cat sat on the mat and then it slept", "b"),
        (6, "The cat sat on the mat and then it slept", "b"),
        (None, "The cat sat on the mat and then it slept", "c"),
        (None, None, None),
        (10, "日本語 \xa0 ümlaut \x00 <|endoftext|> </s>[INST] \\ it's 12345 👨‍👩‍👧", "é"),
        (11, "One TWO", "d"),
    ]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")
