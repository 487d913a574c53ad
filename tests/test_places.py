"""Positions as numbers: files laid end to end, ranks where that won't do, and plans that follow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_job import files, modelled  # noqa: F401
from test_rows import by_weight, drawn, numbered, round_robin

import corpus_blend as cb
from corpus_blend.operators import interleave as mixing
from corpus_blend.operators import places
from corpus_blend.plans import merge
from corpus_blend.plans.spec import MergeSpec

SPREAD = [(0, "b", 5), (0, "a", 7), (0, "a", -3), (1, "", 1 << 40), (1, "", 0), (3, "x", 2), (3, "x", 3), (3, "y", 0)]


def positions(spark, rows):
    return spark.createDataFrame([(*r, f"t{i}") for i, r in enumerate(rows)], "_src int, _file string, _row bigint, text string")


@pytest.mark.parametrize(("few", "most"), [(1000, 1000), (0, 1000), (0, 0)])
def test_numbers_keep_the_order_and_lead_back(spark, monkeypatch, few, most):
    monkeypatch.setattr(places, "FEW_FILES", few)
    monkeypatch.setattr(places, "MOST_FILES", most)
    rows = positions(spark, SPREAD)
    found = places.places_of(rows)
    assert found.packed == (most > 0) and found.counts == {0: 3, 1: 2, 3: 3} and not (found.packed and found.without_gaps)
    packed = found.pack(rows)
    assert "_file" not in packed.columns and "_row" not in packed.columns
    got = {r.text: r for r in found.indexed(packed).collect()}
    order = sorted(range(len(SPREAD)), key=lambda i: SPREAD[i])
    assert sorted(got, key=lambda t: got[t]["_at"]) == [f"t{i}" for i in order]
    for s in (0, 1, 3):
        own = [i for i in order if SPREAD[i][0] == s]
        assert [got[f"t{i}"]["_index"] for i in own] == list(range(len(own)))
    back = {r.text: (r["_src"], r["_file"], r["_row"]) for r in found.unpack(packed).collect()}
    assert back == {f"t{i}": p for i, p in enumerate(SPREAD)}


@pytest.mark.parametrize("rows", [[(0, "", -(1 << 63)), (0, "", (1 << 63) - 1), (0, "", 5)], [(0, "", 1 << 62), (0, "", (1 << 62) + 1)]])
def test_numbers_too_far_apart_are_ranked(spark, rows):
    found = places.places_of(positions(spark, rows))
    assert not found.packed
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    got = {r.text: r["_at"] for r in found.pack(positions(spark, rows)).collect()}
    assert got == {f"t{i}": k for k, i in enumerate(order)}


def test_without_gaps_rows_are_numbered_where_they_lie(spark):
    found = places.places_of(numbered(spark, 10))
    assert found.packed and found.without_gaps
    plan = found.indexed(found.pack(numbered(spark, 10)))._jdf.queryExecution().executedPlan().toString()
    assert " Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert places.places_of(numbered(spark, 0)).counts == {}


def gapped(spark, n, by=3):
    return numbered(spark, n).withColumn("_row", F.col("_row") * by)


@pytest.mark.parametrize("weights", [None, [5, 2, 3]])
def test_rows_with_gaps_mix_like_rows_without(spark, weights):
    sizes = [40, 7, 23]
    mixed = cb.interleave([gapped(spark, n) for n in sizes], weights, 11)
    want = by_weight(sizes, weights, 11, "all_exhausted") if weights else round_robin(sizes, "all_exhausted")
    assert drawn(mixed) == want
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 0  # the numbered positions are written, the text is not


def test_draws_are_neither_exchanged_nor_ranked(spark):
    plan = mixing.plan_picks(spark, {0: 4000, 1: 9000}, [1, 2], 7, block=64)
    text = plan.draws._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text and "Join" not in text
    assert plan.draws.count() == sum(plan.counts.values())


def test_blocks_are_added_up_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS_TOGETHER", 3)
    monkeypatch.setattr(mixing, "_enough", lambda *_: 60)
    sizes, weights = [90, 30], [2, 1]
    counted = []
    real = mixing._Drawing.counted
    monkeypatch.setattr(mixing._Drawing, "counted", lambda self, a, b: counted.append((a, b)) or real(self, a, b))
    mixed = cb.interleave([numbered(spark, n) for n in sizes], weights, 3, block=8)
    assert drawn(mixed) == by_weight(sizes, weights, 3, "all_exhausted")
    assert len(counted) > 1 and all(a == b for (_, a), (b, _) in zip(counted, counted[1:], strict=False))


def test_the_first_of_equal_rows_is_found_by_hashing(spark, files, monkeypatch):  # noqa: F811
    plans = []
    real = merge.stage
    monkeypatch.setattr(merge, "stage", lambda df, name: plans.append((name, df)) or real(df, name))
    merge.Blend(spark, MergeSpec.from_dict({"datasets": [{"local_path": f} for f in files], "output": {"target_format": "chatml"}}))
    found = dict(plans)
    text = found["survivors"]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "HashAggregate" in text
    assert not {"_file", "_row", "source_dataset", "source_split"} & set(found["facts"].columns)


@pytest.mark.parametrize("out", [
    {}, {"mode": "interleave", "probabilities": [3, 1]}, {"mode": "interleave", "dedupe": False, "train_test_split": 0.5},
    {"mode": "interleave", "probabilities": [1, 3], "stopping_strategy": "first_exhausted", "shuffle": False},
    {"dedupe": False, "train_test_split": 0.5},
], ids=str)
def test_merges_of_ranked_rows(spark, files, tmp_path, monkeypatch, out):  # noqa: F811
    monkeypatch.setattr(places, "FEW_FILES", 0)
    monkeypatch.setattr(places, "MOST_FILES", 0)
    spec = MergeSpec.from_dict({"datasets": [{"local_path": f} for f in files], "output": {**out, "save_path": str(tmp_path / "o")}})
    summary = cb.run_merge(spark, spec)
    before, after, final, dropped = modelled(out, files)
    assert (summary["rows_before_filters"], summary["rows_after_filters"], summary["final_rows"]) == (before, after, len(final))
    assert summary["duplicate_examples"] == dropped
    written = spark.read.json(summary["save_files"]["jsonl"])
    assert sorted((r.source_dataset, [(m.role, m.content) for m in r.messages]) for r in written.collect()) == sorted(final)
