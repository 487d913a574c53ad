"""Small frames with the rows that operators must bear: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))

ROWS = [
    (1, "The cat sat on the mat, and the dog\nslept beside it.", "en", "a", 50),
    (2, "The cat  sat on the mat, and the dog slept beside it.", None, "a", 51),
    (3, None, "en", None, None),
    (4, "", "de", "b", 0),
    (5, " \t\n ", "de", "b", 4),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG + " end", "en", "c", len(LONG) + 4),
    (8, "naïve Übung 日本語 🤷🏽‍♂️ <|endoftext|> it's", "xx", "c", 30),
    (9, "same text twice", "en", "a", 15),
    (9, "same text twice", "en", "a", 15),
    (None, "a row without an id", "en", "a", 19),
    (10, "a b a b a b a b " * 50, "en", "a", 800),
]
# Columns that clash with names the operators use for themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["id", "score", "ids", "fingerprint", "component", "kept", "rank", "at", "sha256", "path", "file", "size", "label"]


def documents(spark, rows=None):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return frame.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING))


def empty(spark):
    return documents(spark, [])
