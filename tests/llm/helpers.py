"""Small tables with the odd cases that every operator has to define."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("N_words", T.StringType()),
        T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()),
    ]
)

LONG = "the quick brown fox jumps over the lazy dog and runs away from it " * 4000
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 3),
    (2, "One two three four five six seven eight nine ten eleven twelve", "en", "a", 3),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "de", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (7, "x" * 100_000, None, "b", 100_000),
    (7, "x" * 100_000, None, "b", 100_000),
    (None, "mail bob@example.com now, é\U0001f600 call +1 (406) 555-0113 or 10.0.0.255", "fr", None, 1),
    (8, "line one here\nline one here\n\nline two\r\nline one here", "fr", "c", 50),
]


def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ODD], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
