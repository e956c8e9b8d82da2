"""Small tables with what operators must get right: nulls, empty and very long texts, ties, repeats, clashing names."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside themselves
        *[T.StructField(c, T.StringType()) for c in ("tie", "node", "label", "digest", "block", "tokens", "key", "length", "part", "n", "rank", "__loc", "_metadata")],
    ]
)


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), any of them null, with extra columns."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), *["x"] * 13) for i, t, l, s in rows], DOCS)


LONG = "palabra larga de muestra " * 20_000

AWKWARD = [
    (1, "one small text of a few words that stands here", "en", "a"),
    (1, "one small text of a few words that stands here", "en", "a"),
    (1, "quite another text under the same number as the one before", "en", "b"),
    (None, "a text without a number", "en", "a"),
    (None, None, None, None),
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, "", None, "b"),
    (5, " \n\t ", "en", "a"),
    (6, "12345 !!! ???", "de", "a"),
    (7, LONG, "es", "b"),
    (8, "Ünïcödé ★ 字符 🎉 text", None, "c"),
]
