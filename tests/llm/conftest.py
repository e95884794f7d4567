import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "no id"), (6, "x" * 20_000),
    (7, "a b c d e f g h " * 3_000), (8, "é ü ß ñ   　 漢字 \U0001f600 é"), (9, "1" * 5_000), (10, "line\n" * 40),
]


def documents(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) as a documents table with columns whose names may clash."""
    from pyspark.sql import functions as F

    full = [(r[0], r[1], *(r[2:3] or ("en",)), *(r[3:4] or ("s",)), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumns(
        {n: F.lit("clash") for n in ("slot", "shard", "words", "label", "score", "length", "count", "value", "key")})


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
