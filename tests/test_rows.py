"""Combining, cleaning, choosing and ordering rows, against plain Python models."""

import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_blend as cb
from corpus_blend.operators import interleave as mixing
from corpus_blend.operators import report, select

CHAT = "messages array<struct<role:string,content:string>>"


def numbered(spark, n, start=0, parts=3):
    df = spark.range(start, start + n, 1, parts).select(F.col("id").alias("key"))
    return cb.with_position(df, "key")


def texts(spark, values, label="here"):
    df = spark.createDataFrame(list(enumerate(values)), "key bigint, text string").repartition(3)
    return cb.to_target(cb.with_position(df, "key"), "text", "text", label, keep=["key"])


def number(salt, key):
    return int(hashlib.md5(f"{salt}:{key}".encode()).hexdigest()[:13], 16)


def keys(df, name="key"):
    return [r[name] for r in df.collect()]


# --- combining -------------------------------------------------------------------------


def test_concatenate(spark):
    a, b = texts(spark, ["x", "y"], "a"), texts(spark, ["x"], "b")
    both = cb.concatenate([a, b])
    assert both.count() == 3
    assert {(r._src, r.source_dataset) for r in both.collect()} == {(0, "a"), (1, "b")}
    wider = cb.concatenate([a, b.withColumn("more", F.lit(1))])
    assert {r.more for r in wider.collect()} == {None, 1}
    with pytest.raises(ValueError, match="text"):
        cb.concatenate([a, b.withColumn("text", F.lit(1))])
    with pytest.raises(ValueError):
        cb.concatenate([])


def drawn(df):
    return [(r._from, r._index) for r in df.orderBy("_row").collect()]


def round_robin(sizes, stop):
    live = [s for s, n in enumerate(sizes) if n]
    turns = (max if stop == "all_exhausted" else min)([sizes[s] for s in live])
    return [(s, t % sizes[s]) for t in range(turns) for s in live]


def by_weight(sizes, weights, seed, stop):
    """One draw after the other, each source starting over at its end."""
    shares = [w / sum(weights) for w in weights]
    taken, done, out, t = [0] * len(sizes), set(), [], 0
    while len(done) < (len(sizes) if stop == "all_exhausted" else 1):
        u, upto = number(seed, t) / 2**52, 0.0
        for s, share in enumerate(shares):
            upto += share
            if u < upto or s == len(shares) - 1:
                break
        out.append((s, taken[s] % sizes[s]))
        taken[s] += 1
        if taken[s] == sizes[s]:
            done.add(s)
        t += 1
    return out


@pytest.mark.parametrize("stop", ["all_exhausted", "first_exhausted"])
def test_round_robin(spark, stop):
    sizes = [3, 5, 0, 2]
    frames = [numbered(spark, n) for n in sizes]
    mixed = cb.interleave(frames, stop=stop)
    assert drawn(mixed) == round_robin(sizes, stop)


@pytest.mark.parametrize("stop", ["all_exhausted", "first_exhausted"])
@pytest.mark.parametrize("block", [16, 1 << 20])
def test_weighted(spark, stop, block):
    sizes, weights = [40, 7, 23], [5, 2, 3]
    frames = [numbered(spark, n) for n in sizes]
    mixed = cb.interleave(frames, weights, 11, stop, block=block)
    assert drawn(mixed) == by_weight(sizes, weights, 11, stop)


def test_more_draws_are_made_when_the_first_do_not_suffice(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_enough", lambda *_: 10)
    sizes, weights = [9, 30], [1, 1]
    mixed = cb.interleave([numbered(spark, n) for n in sizes], weights, 3, block=8)
    assert drawn(mixed) == by_weight(sizes, weights, 3, "all_exhausted")


def test_copies_in_chunks(spark):
    rows = cb.dense_index(cb.concatenate([numbered(spark, 3), numbered(spark, 100)]), within="_src")
    picked = mixing._picked(rows, {0: 3, 1: 100}, {0: 100, 1: 100}, None, chunk=7, rows_per_task=20)
    got = sorted((r._src, r._pick, r._index) for r in picked.collect())
    assert got == [(0, k, k % 3) for k in range(100)] + [(1, k, k) for k in range(100)]
    few = mixing._picked(rows, {0: 3, 1: 100}, {0: 100, 1: 100}, 2, chunk=7, rows_per_task=20)
    assert sorted(r._pick for r in few.where("_src = 0").collect()) == [0, 1, 2, 3, 4, 5]


def test_weights():
    assert cb.normalize_weights([1, 1, 1]) == [1 / 3] * 3
    assert cb.normalize_weights([1, 0], "first_exhausted") == [1, 0]
    for bad in ([1, 0], [-1, 2], [0, 0], [float("nan"), 1]):
        with pytest.raises(ValueError):
            cb.normalize_weights(bad)


def test_interleave_arguments(spark):
    frames = [numbered(spark, 2), numbered(spark, 2)]
    with pytest.raises(ValueError, match="weights"):
        cb.interleave(frames, [1.0])
    with pytest.raises(ValueError, match="stopping"):
        cb.interleave(frames, stop="never")


# --- cleaning ------------------------------------------------------------------------


def test_system_prompt(spark):
    df = spark.createDataFrame(
        [(1, [("user", "q")]), (2, [("system", "s"), ("user", "q")]), (3, []), (4, None), (5, [(None, "x")])],
        f"key int, {CHAT}",
    )
    opened = {r.key: [(m.role, m.content) for m in r.messages] for r in cb.inject_system_prompt(df, "P").collect()}
    assert opened == {
        1: [("system", "P"), ("user", "q")],
        2: [("system", "s"), ("user", "q")],
        3: [("system", "P")],
        4: [("system", "P")],
        5: [("system", "P"), (None, "x")],
    }
    assert cb.inject_system_prompt(df, "") is df


def test_length_filter(spark):
    df = texts(spark, ["", "ab", "é😀x", "abcdef"])
    assert sorted(keys(cb.filter_length(df, "text", 2, 3))) == [1, 2]
    assert sorted(keys(cb.filter_length(df, "text", None, 0))) == [0]
    assert cb.filter_length(df, "text", None, None) is df


VARIANTS = ["Hello  World", "hello world", " hello\tworld ", "hello world", "other", "other", "Other"]


def test_dedupe(spark):
    df = texts(spark, VARIANTS)
    assert sorted(keys(cb.dedupe(df, "text"))) == [0, 1, 2, 3, 4, 6]
    assert sorted(keys(cb.dedupe(df, "text", normalize=True))) == [0, 4]
    again = cb.dedupe(df.repartition(7), "text", normalize=True)
    assert sorted(keys(cb.dedupe(again, "text", normalize=True))) == [0, 4]
    dropped = cb.duplicates(df, "text", normalize=True).orderBy("_row").collect()
    assert [(r._row, r.preview) for r in dropped] == [(i, VARIANTS[i]) for i in (1, 2, 3)]


def test_payload_collision(spark):
    df = spark.createDataFrame(
        [(0, [("user", "x||user:y")]), (1, [("user", "x"), ("user", "y")])], f"key bigint, {CHAT}"
    )
    rows = cb.to_target(cb.with_position(df, "key"), "chatml", "chatml", keep=["key"])
    assert keys(cb.dedupe(rows, "chatml")) == [0]
    assert sorted(keys(cb.dedupe(rows, "chatml", strict=True))) == [0, 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "A", " a", "b", "b ", "", "c c", "c  c"]), min_size=1, max_size=30))
def test_dedupe_model(spark, values):
    def clean(v):
        return " ".join(v.split()).lower()

    df = texts(spark, values)
    exact = sorted({v: i for i, v in reversed(list(enumerate(values)))}.values())
    loose = sorted({clean(v): i for i, v in reversed(list(enumerate(values)))}.values())
    assert sorted(keys(cb.dedupe(df, "text"))) == exact
    assert sorted(keys(cb.dedupe(df, "text", normalize=True))) == loose


def test_hot_copies_shrink_before_the_exchange(spark):
    kept = cb.dedupe(texts(spark, ["same"] * 50), "text")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_normalized_text(spark):
    from corpus_blend.functions.text import is_blank, normalize_text

    spaces = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    others = ["\u200b", "\u2060", "\ufeff", "\x00", "\x0e", "\x84", "é", "İ", "ß", "Σ", "漢"]
    values = [f"A{s}{s} {s}b{s}" for s in spaces] + [f" a{o}{o}  B" for o in others]
    values += ["", " ", "  \n\t ", " " * 1001 + "x", "x" + " \x1c " * 3 + "y", None, *spaces, *others]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", normalize_text(F.col("v")).alias("n"), is_blank(F.col("v")).alias("b")).collect():
        assert r.n == " ".join((r.v or "").split()).lower(), repr(r.v)
        assert r.b == (not (r.v or "").strip()), repr(r.v)


# --- choosing and ordering --------------------------------------------------------


def in_hash_order(n, salt):
    return sorted(range(n), key=lambda k: (number(salt, k), k))


@pytest.mark.parametrize("small", [10_000, 3, 1])
def test_exact_sample(spark, small):
    rows = numbered(spark, 1000)
    got = keys(cb.sample_fraction(rows, 0.137, 5, "key", small=small))
    assert sorted(got) == sorted(in_hash_order(1000, "5/sample")[:137])


@pytest.mark.parametrize("fraction, kept", [(None, 9), (0, 9), (1, 9), (1.5, 9), (0.01, 1), (0.5, 4)])
def test_sample_sizes(spark, fraction, kept):
    assert cb.sample_fraction(numbered(spark, 9), fraction).count() == kept


def test_sample_of_nothing(spark):
    assert cb.sample_fraction(numbered(spark, 0), 0.5).count() == 0


def test_key_must_tell_rows_apart(spark):
    rows = numbered(spark, 50).withColumn("same", F.lit(1))
    for small in (10_000, 1):
        with pytest.raises(ValueError, match="same"):
            cb.sample_fraction(rows, 0.5, key="same", small=small)


def test_split(spark):
    rows = numbered(spark, 101)
    split = cb.split_train_test(rows, 0.1, 7, "key")
    test = keys(split.where("split = 'test'"))
    assert sorted(test) == sorted(in_hash_order(101, "7/split")[: math.ceil(10.1)])
    assert split.where("split = 'train'").count() == 90
    assert cb.split_train_test(rows, 5, 7, "key").where("split = 'test'").count() == 5
    assert keys(cb.split_train_test(rows, None), "split") == ["train"] * 101
    for bad in (1.0, 1.5, 101, -1):
        with pytest.raises(ValueError):
            cb.split_train_test(rows, bad, 7, "key")


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_shuffle_order(spark, partitions):
    assert keys(cb.shuffle(numbered(spark, 200), 42, "key", partitions)) == in_hash_order(200, "42")


def test_shuffle_takes_one_exchange_and_no_sampling(spark):
    plan = cb.shuffle(numbered(spark, 9), 42, "key", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "shufflepartitionidpassthrough" in plan


@pytest.mark.parametrize("ordered_take", [100, 0])
@pytest.mark.parametrize("n, kept", [(7, 7), (500, 40), (0, 40), (None, 40)])
def test_first_rows(spark, n, kept, ordered_take):
    rows = numbered(spark, 40, 1000).repartition(5)
    got = cb.first_rows(rows, n, ordered_take=ordered_take)
    assert sorted(keys(got)) == list(range(1000, 1000 + kept))


def test_dense_index(spark):
    rows = spark.range(300).select((F.col("id") * 7 % 300).alias("k"), (F.col("id") % 3).alias("g"))
    all_rows = {r.k: r._index for r in cb.dense_index(rows, "k").collect()}
    assert all_rows == {k: k for k in range(300)}
    grouped = cb.dense_index(rows, "k", within="g").collect()
    for g in range(3):
        mine = sorted((r.k, r._index) for r in grouped if r.g == g)
        assert [i for _, i in mine] == list(range(len(mine)))
    assert cb.dense_index(rows.where("false"), "k").count() == 0


def test_peek(spark):
    assert keys(select.peek(numbered(spark, 50), 3, "key")) == [0, 1, 2]
    assert select.peek(numbered(spark, 50), 3).count() == 3


# --- reports ------------------------------------------------------------------------------


def test_quality(spark):
    rows = cb.concatenate([texts(spark, ["a", "  ", ""], "x"), texts(spark, ["b"] * 20, "y")])
    by = {r.source_dataset: r for r in report.quality(rows, "text", "source_dataset").collect()}
    assert (by["x"].empty_rows, by["x"].flagged, by["y"].empty_rows, by["y"].flagged) == (2, True, 0, False)
    nothing = report.quality(rows.where("false"), "text").first()
    assert (nothing.sample_size, nothing.empty_rate, nothing.flagged) == (0, 0.0, False)


def test_histogram(spark):
    import pandas as pd

    lengths = [0, 1, 5, 5, 12, 30, 31, 59, 60, 61, 100, 119, 120]
    rows = texts(spark, ["x" * n for n in lengths])
    got = {r.bin: r.n_rows for r in report.length_histogram(rows, "text").collect()}
    cut = pd.cut(pd.Series(lengths), bins=12, labels=range(1, 13))
    assert got == cut.value_counts().loc[lambda c: c > 0].to_dict()
    same = report.length_histogram(texts(spark, ["ab", "cd"]), "text").collect()
    assert [(r.bin, r.n_rows, r.shortest, r.longest) for r in same] == [(1, 2, 2, 2)]


def test_merge_statistics(spark):
    rows = cb.concatenate([texts(spark, ["a", "bb"], "x"), texts(spark, ["ccc"], "y")])
    tables = report.merge_statistics(rows, "text")
    assert {tuple(r) for r in tables["source_counts"].collect()} == {("x", 2), ("y", 1)}
    assert sum(r.n_rows for r in tables["lengths"].collect()) == 3 and "role_counts" not in tables


def test_profile(spark):
    df = spark.createDataFrame(
        [("q", None), ("", "[{x"), (" ", " ")], "question string, answer string"
    )
    row = report.profile_source(df, "s").first()
    assert (row.format, row.n_rows, row.n_missing, row.n_empty, row.n_json_like) == ("qa", 3, 2, 1, 1)
    assert row.avg_length == pytest.approx((1 + 3 + 2) / 3)
    with pytest.raises(ValueError):
        report.profile_roles(df, "s")
