"""Small awkward tables for the corpus operators."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977} piece{i * 7 % 1013}" for i in range(20000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (None, "no id here, naïve façade ß 日本語", "fr", "b", 3),
    (5, " \t\n ", "en", "c", 4),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG + " x", "en", "c", len(LONG) + 2),
    (-8, "single", "en", "d", 6),
    (9, "aaaa" * 400, "en", "d", 1600),
]


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)


def clash(df, *names):
    """The table with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names})
