"""Toxicity by held-out accuracy, embeddings against all pairs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from frames import ROWS, documents, empty

from corpus_blend.llm import embedding_dedup, toxicity

SYLLABLES = "ba ke li mo nu ra se ti vo zu fa gi".split()
BAD = ["scumbag", "worthless", "filthpig", "idiotic"]
SMALL = toxicity.Settings(max_rows=1200, epochs=20, buckets=1 << 16, batch=100)


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def misspelt(rng, word):
    at = rng.randrange(1, len(word) - 1)
    return word[:at] + word[at] + word[at:]


def labelled(n, seed=0):
    """Texts of all lengths; a toxic one holds one or two bad words, spelt anyhow."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, toxic = words(rng, rng.choice([5, 30, 200, 600])), rng.random() < 0.3
        for _ in range(rng.randint(1, 2) if toxic else 0):
            bad = rng.choice(BAD)
            text.insert(rng.randrange(len(text)), (misspelt(rng, bad) if rng.random() < 0.5 else bad) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(text), "en", f"src{i % 3}", 1, int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(1200)
    docs = documents(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, SMALL)
    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [(got[r[0]] >= 0.5) == r[5] for r in unseen]
    assert len(unseen) > 100 and np.mean(right) > 0.95
    clean, never_seen = words(random.Random(9), 40), ["scumbagg", "filthpigs", "worthlesss", "sscumbag"]
    scores = model.score(pa.array([" ".join(clean), *(" ".join([*clean, w]) for w in never_seen)]))
    assert scores[0] < 0.01 and (scores[1:] > 20 * scores[0]).all() and (scores[1:] >= 0.5).sum() >= 3
    kept = toxicity.reject(docs, model).collect()
    assert {r.doc_id for r in kept} == {i for i, s in got.items() if s < 0.5} and kept[0].id == "extra id"


def test_held_out_rows_are_never_learned_from(spark):
    rows = labelled(60)
    docs = documents(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(0, 0), (0, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels, SMALL).collect()
    assert {r.id for r in sample} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[0] != 0}
    few = toxicity.labelled_sample(docs, labels, toxicity.Settings(max_rows=10)).collect()
    assert 0 < len(few) < 30


def test_toxicity_of_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark), labels, SMALL)
    got = toxicity.score(documents(spark), model).collect()
    assert sorted((r.id for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id in (3, 4, 5)}) == 1
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.fit(empty(spark), labels.where("false"), SMALL)
    assert {r.score for r in toxicity.score(documents(spark), none).collect()} == {0.5}


def test_windows_cover_every_word():
    for n in (0, 1, 5, 6, 11, 12, 13, 17, 18, 30, 31):
        begin, end, first = toxicity.windows(np.array([n, n + 3]), 12)
        assert first[0] == 0 and begin[0] == 0 and end[first[1] - 1] == n and end[-1] == n + 3
        assert (begin[1 : first[1]] == end[: first[1] - 1]).all() and (end - begin < 18).all()


def test_subwords_are_those_of_each_word():
    settings = toxicity.Settings(buckets=1 << 20)
    names = ["a", "moron", "mo", "straße", "x" * 400, "日本語"]
    found, begin = toxicity.subwords(names, settings)
    for name, part in zip(names, np.split(found, begin[1:]), strict=True):
        alone, _ = toxicity.subwords([name], settings)
        grams = sum(max(0, len(name) + 2 - n + 1) for n in range(settings.shortest, settings.longest + 1))
        assert part.tolist() == alone.tolist() and len(part) == grams + 1


# --- embeddings -------------------------------------------------------------------------


def vectors(seed, n=240, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3])).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies
    rows += [(2000 + i, [x * 7.0 for x in rows[1][1]]) for i in range(3)]  # same direction
    return rows


def pairs_model(rows, threshold=0.9):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= threshold
    label = np.arange(len(rows))
    while not np.array_equal(label, low := np.array([label[r].min() for r in close])):
        label = low
    ids = np.array([i for i, _ in rows])
    return {i: (int(c.sum()) - 1, int(ids[label == k].min())) for i, c, k in zip(ids.tolist(), close, label, strict=True)}


@pytest.mark.parametrize("settings", [
    embedding_dedup.Settings(lists=6, sample=100, block=32),
    embedding_dedup.Settings(lists=1, subspaces=3, codewords=4),
])
def test_links_like_all_pairs(spark, settings):
    rows = vectors(1)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' id", "1 list", "2 node")
    got = embedding_dedup.embedding_dedup(frame, settings=settings).collect()
    want = pairs_model(rows)
    assert {r.id: (r.n_links, r.component) for r in got} == want
    assert all(r.kept == (r.id == r.component) for r in got)


def test_a_margin_searches_fewer_lists_with_high_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 32)) * 0.35
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    quantizer = embedding_dedup.train(x, 40, embedding_dedup.Settings())
    own = np.argmax(x @ quantizer.centroids.T, axis=1)
    links = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert len(links) > 200
    exact, fewer = quantizer.probes(x, np.sqrt(0.2)), quantizer.probes(x, 0.2)
    assert exact[links[:, 0], own[links[:, 1]]].all()
    assert fewer[links[:, 0], own[links[:, 1]]].mean() >= 0.9 and fewer.sum() < exact.sum() / 2


def test_reconstruction_error_bounds_the_distance():
    x = np.random.default_rng(4).normal(size=(500, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    quantizer = embedding_dedup.train(x[:300], 5, embedding_dedup.Settings(subspaces=4, codewords=16))
    lists, codes, error = quantizer.assign(x)
    sums = x @ quantizer.centroids[lists].T + sum(t[:, codes[:, m]] for m, t in enumerate(quantizer.tables(x)))
    assert (np.abs(sums - x @ x.T) <= error[None, :] + 1e-6).all()


def test_embeddings_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]),
        (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.02]), (10, [1e-200, 0.0]), (2, [1.0, 0.01]),
    ]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    found = sorted(((r.id, r.n_links, r.component, r.kept) for r in got), key=str)
    linked = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (10, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert found == sorted(linked + alone, key=str)
    nothing = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_dedup.embedding_dedup(nothing).count() == 0


def test_vectors_of_every_length_are_searched(spark):
    """Equal and close vectors of rarer lengths link too; an id may occur in two lengths."""
    rows = [(1, [1.0] * 8), (2, [1.0] * 8), (3, [1.0] * 7 + [1.1]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [2.0, 4.1]),
            (7, [1.0, -1.0]), (8, [5.0]), (9, [0.1]), (10, [-1.0])]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    want = {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (0, 10)}
    assert {r.id: (r.n_links, r.component) for r in got} == want
