"""The first rows by a key found between two sampled ones, against sorting."""

from __future__ import annotations

import random

import pytest

import corpus_blend as cb
from corpus_blend.operators import select


@pytest.fixture
def few_samples(monkeypatch):
    monkeypatch.setattr(select, "SAMPLED", 400)
    indexed = select.dense_index

    def of_few(df, *order):
        assert df.count() < 2_000, "all keys were sorted"
        return indexed(df, *order)

    monkeypatch.setattr(select, "dense_index", of_few)


@pytest.mark.parametrize("n", [11, 4_000, 7_990, 8_000, 8_001])
def test_text_and_number(spark, few_samples, n):
    rng = random.Random(3)
    rows = sorted({(rng.choice("abcdé") * rng.randrange(1, 3), rng.randrange(-(1 << 60), 1 << 60)) for _ in range(8_000)})
    assert len(rows) == 8_000
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "name string, at bigint").repartition(5)
    got = cb.first_rows(df, n, ["name", "at"], ordered_take=10)
    assert sorted(tuple(r) for r in got.collect()) == rows[:n]


def test_keys_that_say_little(spark, monkeypatch):
    monkeypatch.setattr(select, "SAMPLED", 50)
    same = spark.range(3_000).selectExpr("id div 2900 as k", "id")
    assert cb.first_rows(same, 100, "k", ordered_take=10).count() == 2_900
    some = spark.range(3_000).selectExpr("if(id < 5, null, id) as k")
    want = sorted(r.k for r in cb.first_rows(some, 100, "k", ordered_take=10).collect())
    assert want == list(range(5, 100))
