import pytest
from pyspark.sql import functions as F

#: A document table with everything that operators must bear.
SPECIAL = ["", None, "a", "x " * 30_000, "same text", "same text", "Ünïcödé ’quotes’ ́ 日本語 text", "\n\n \t\n", "<|endoftext|> it's 12,34!!"]


@pytest.fixture(scope="session")
def special(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1) for i, t in enumerate(SPECIAL)]
    rows += [(4, "same text", None, "s", 1), (None, "without id", "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "score", "start", "kept", "name", "id", "digest", "part", "bucket", "tokens", "hash", "own_id", "root", "n", "path", "sha"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(special):
    return special.limit(0)
