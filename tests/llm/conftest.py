import pytest
from pyspark.sql import types as T

#: Rows that every operator on documents must take: nulls, empty and blank texts, repeats, ties, a very long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, " \n\t ", "de", "s", 4),
    (4, "word", "en", "s", 4),
    (4, "word", "en", "s", 4),
    (4, "other words under one id", "en", None, 9),
    (None, "a row without an id but with quite a few words in it", "en", "s", 1),
    (6, "%%% 123 !!!", "fr", "t", 3),
    (7, "x" * 300_000, None, "t", 1),
    (8, "ab " * 60_000, "es", "t", 1),
    (9, "日本語 テキスト 🙂 é\x00​", "fr", "ü", 2),
]
COLUMNS = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
#: Names that operators give to columns of their own.
CLASHING = ["ids", "decoded", "n_tokens", "spans", "score", "lang_pred", "size", "target", "taken", "source_size", "finish_time", "n_bytes", "n_removed", "n_spans", "kept", "id", "group", "component", "hashes", "_text", "_digest"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, T.StructType(COLUMNS))


@pytest.fixture(scope="session")
def clashing(spark):
    schema = T.StructType(COLUMNS + [T.StructField(c, T.StringType()) for c in CLASHING])
    return spark.createDataFrame([(*r, *["old"] * len(CLASHING)) for r in ODD], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType(COLUMNS))


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
