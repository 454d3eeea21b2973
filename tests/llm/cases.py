"""Awkward documents that every operator must take, and helpers."""

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Extra columns named like those that operators add or use on the way.
CLASHING = ("key", "row", "fp", "tokens", "spans", "copies", "leaf", "score", "shard", "slot", "m", "found", "label", "at")

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and the dog lay on the rug by the door of the old house today.", "en", "src1", 87),
    (2, None, "en", "src1", None),
    (3, "", None, "src2", 0),
    (4, " \t\n ", "de", None, 4),
    (5, LONG, "en", "src0", len(LONG)),
    (6, "x" * 50_000, "fr", "src0", 50_000),
    (7, "Ünï çødé 😀   token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" end", "es", "src3", 60),
    (7, "Ünï çødé 😀   token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" end", "es", "src3", 60),
    (None, "no id here", "en", "src1", 10),
    (None, None, None, None, None),
    (8, "The cat sat on the mat and the dog lay on the rug by the door of the old house today.", "en", "src1", 87),
    (-9, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "src1", 55),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCUMENT)


def clashing(frame):
    """The documents with extra columns whose names operators use themselves."""
    for i, name in enumerate(CLASHING):
        frame = frame.selectExpr("*", f"{i} AS `{name}`")
    return frame


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
