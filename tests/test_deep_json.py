"""Message content nested deeper than expressions are written out for, against the written-out form."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions import text as t

NAMES = ("text", "content", "value", "type", "other", 'a"b')
LEAVES = ("", "word", "two\nlines", 'with "quotes" and \\', "é[{,:}]", "text", "image", 1, 2.5, -3, True, False, None, "7")


def value(rng: random.Random, depth: int):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice(LEAVES)
    if kind < 0.6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NAMES): value(rng, depth - 1) for _ in range(rng.randrange(4))}


def texts(spark, rows, depth, monkeypatch):
    monkeypatch.setattr(t, "JSON_DEPTH", depth)
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, s string").repartition(2, "i")
    found = frame.select("i", t.to_text(F.col("s"), T.StringType(), json_content=True).alias("text"))
    return [r.text for r in found.orderBy("i").collect()]


def test_folding_is_the_same_as_writing_out(spark, monkeypatch):
    rng = random.Random(3)
    rows = [json.dumps(value(rng, 5), ensure_ascii=False) for _ in range(400)]
    written = texts(spark, rows, 6, monkeypatch)
    assert len(set(written)) > 100
    assert texts(spark, rows, 0, monkeypatch) == written
    assert texts(spark, rows, 2, monkeypatch) == written


@pytest.mark.parametrize("levels", [17, 40, 300])
def test_any_number_of_levels(spark, levels):
    deep: object = ['in"ner', {"type": "image", "url": "x"}, {"type": "text", "value": "too"}]
    for i in range(levels):
        deep = [deep] if i % 2 else {"content": deep}
    frame = spark.createDataFrame([(json.dumps(deep),), (None,)], "s string")
    found = frame.select(t.to_text(F.col("s"), T.StringType(), json_content=True).alias("text")).collect()
    assert sorted(r.text for r in found) == ["", 'in"ner\ntoo']
