"""Small frames with the cases every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # extra columns under names that the operators use themselves
        *(T.StructField(n, T.StringType()) for n in ("id", "row", "key", "fp", "score", "tokens", "take", "g", "part", "root", "odd `name")),
    ]
)
EXTRA = tuple("x" for _ in range(len(SCHEMA) - 5))
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil green tea near the river bank at dawn"
LONG = " ".join(f"word{i} of a very long text" for i in range(12_000))

EDGE = [
    (1, SENTENCE, "en", "src1", 5),
    (2, SENTENCE.upper(), "en", "src1", 5),  # equal but for case
    (2, SENTENCE.upper(), "en", "src1", 5),  # repeated row
    (3, None, "en", "src2", None),
    (4, "", "de", "src2", 0),
    (None, SENTENCE + " again", "de", "src3", 7),
    (None, None, None, None, None),
    (5, LONG, "fr", "src2", len(LONG)),
    (6, LONG, "fr", None, len(LONG)),
    (7, " \n\t ", None, "src4", 4),
    (8, "short", "es", "src5", 5),
    (9, "ünïcödé 日本語 \U0001f600 text with +1 (555) 123-4567 and a@b.example.org", "es", "src6", 3),
    (9, "another text under the same id", "es", "src6", 3),
]


def edge(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in EDGE], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, rows):
    """Documents of ``(doc_id, text)`` pairs."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *EXTRA) for i, t in rows], SCHEMA)


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}
