"""Whitening against the covariance's eigenvectors and exact integer sums."""

from __future__ import annotations

import numpy as np
import pytest

from corpus_blend.llm import whitening
from corpus_blend.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, x string, size string"


def vectors(seed, n, d, shape=None):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * (1 if shape is None else shape)).astype(np.float32).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA)


def model(rows):
    """By length: ids, whole vectors, and what the distinct ones give."""
    found = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            x = [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v]
            found.setdefault(len(v), []).append((i, x))
    return found


def compare(rows, got):
    by = {}
    for r in got:
        by.setdefault((r.id, r.deviation), []).append(r)
    expected = 0
    for d, own in model(rows).items():
        x = np.array([v for _, v in own], dtype=object)
        distinct = np.array(sorted({tuple(v) for _, v in own}), dtype=object)
        n, sums = len(distinct), distinct.sum(axis=0)
        centred = (distinct - np.array([s / n for s in sums])).astype(float)
        e, v = np.linalg.eigh(centred.T @ centred / n)
        e, v = e[::-1], v[:, ::-1]
        k = int((e[:16] > 1e-9 * max(e.sum(), 1e-300)).sum())
        for (i, _), whole in zip(own, x, strict=True):
            exact = int(sum((n * a - s) ** 2 for a, s in zip(whole.tolist(), sums.tolist(), strict=True)))
            found = sorted(by.get((i, exact), []), key=lambda r: r.component)
            assert {r.component for r in found} == set(range(1, k + 1))
            expected += k
            white = (whole - np.array([s / n for s in sums])).astype(float) @ v[:, :k] / np.sqrt(e[:k])
            for r in found:
                assert r.n == n and abs(abs(r.whitened) - abs(white[r.component - 1])) < 1e-8
                assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    assert len(got) == expected


def edge_rows(d):
    first = vectors(9, 1, d)[0]
    return [(900, None), (901, []), (902, [*first[:-1], None]), (903, [*first[:-1], float("nan")]),
            (904, [float("inf"), *first[1:]]), (905, first), (905, first), (None, first), (906, [0.0] * d)]


@pytest.mark.parametrize(("n", "d"), [(400, 64), (50, 6), (9, 40)])
def test_like_eigenvectors(spark, n, d):
    rows = [*enumerate(vectors(n, n, d, np.linspace(1, 0.3, d))), *edge_rows(d)]
    compare(rows, whitening.whiten(frame(spark, rows)).collect())


def test_lengths_apart_and_hot_vectors(spark):
    rows = [(i, v) for i, v in enumerate(vectors(1, 60, 20) + vectors(2, 40, 5) + [[1.0, 2.0]] * 3)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert not [r for r in got if r.id in (100, 101, 102)]  # one vector alone varies in nothing
    compare(rows, got)


def test_signs_are_the_same_for_all_rows(spark):
    rows = list(enumerate(vectors(3, 200, 24)))
    got = whitening.whiten(frame(spark, rows)).collect()
    white = np.zeros((200, 16))
    for r in got:
        white[r.id, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / 200 - np.eye(16)).max() < 1e-9 and np.abs(white.mean(axis=0)).max() < 1e-9


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [1.0, 2.0])])).count() == 0


def test_great_entries_and_sums():
    x = np.array([[1, -5, 1 << 45], [7, 0, -(1 << 45)]], np.int64)
    for n, sums in ((3, [4, 5, 6]), (1 << 20, [1 << 30, -(1 << 31), 1 << 62]), (10**15, [10**20, 5, -(10**25)])):
        want = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]
        assert whitening.deviations(x, n, sums) == [w if w < 10**38 else None for w in want]
    small = np.random.default_rng(0).integers(-(1 << 20), 1 << 20, (50, 9))
    for n in (1, 1 << 12, 1 << 25):
        sums = [n * i for i in range(9)]
        assert whitening.deviations(small, n, sums) == [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in small.tolist()]


def test_the_registered_query(spark, tmp_path):
    rows = [*enumerate(vectors(4, 150, 48)), *edge_rows(48), (950, [1e30] * 48)]
    frame(spark, rows[:-1]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_whitening"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(rows[:-1], got.withColumnRenamed("vec_id", "id").collect())
    # next to an entry of 10^30 nothing else varies
    assert whitening.whiten(frame(spark, rows)).where("id = 950").count() == 1
