"""Ranked lexical search against scores of all documents for all queries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from frames import ROWS, documents, empty

from corpus_blend.llm import lexical_search
from corpus_blend.llm.queries import QUERIES


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def model(docs, items, top=10):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for number, text in items:
        found = []
        for (doc, _), c in zip(docs, counts, strict=True):
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 10
            score = 0
            for t in set(terms(text)):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(number, rank + 1, doc, -score) for rank, (score, _, doc) in enumerate(found[:top])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(common, [1 / (k + 1) for k in range(300)], k=rng.randint(0, 120)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)]  # ties beyond the top
    docs += [(n + 99, "w7 " * 700 + "Ärger ärger ARGER w7é w1-w2"), (n + 99, "w7 " * 700), (None, docs[5][1]), (n + 100, " \x00.-"), (n + 101, None)]
    items = [(i, " ".join(rng.choices(common, k=rng.randint(1, 25)))) for i in range(30)]
    items += [(30, docs[3][1]), (30, docs[5][1]), (31, "W7 w7,w7"), (32, None), (33, "-"), (34, "notthere"), (None, "ärger w1"), (35, "Ärger")]
    return docs, items


def frames(spark, docs, items):
    extra = "id bigint, text string, score string, terms string, rank string"
    found = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], extra.replace("id", "doc_id", 1))
    asked = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in items], extra.replace("id", "item_id", 1))
    return found, asked


@pytest.mark.parametrize(("queries", "numbers"), [(256, 4 << 20), (7, 2000)])
def test_like_scores_of_all_documents(spark, monkeypatch, queries, numbers):
    monkeypatch.setattr(lexical_search, "QUERIES_AT_ONCE", queries)
    docs, items = corpus(1, 300)
    found, asked = frames(spark, docs, items)
    index = lexical_search.build_index(found.repartition(5))
    assert index.columns == ["id", "n", "sketch", "terms", "counts"] and index.count() == len(docs)
    got = lexical_search.search(index, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == model(docs, items)


def test_few_documents_are_scored_and_none_that_counts_is_missed():
    """The searcher alone, on random words of which the tenth best has two or three: bounds hold."""
    rng = random.Random(3)
    words = [f"t{i}" for i in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(3000)]
    items = [(q, " ".join(docs[q * 50][1].split()[:20])) for q in range(20)]
    part = lexical_search._indexed(pa.RecordBatch.from_pydict({"id": [i for i, _ in docs], "text": [t for _, t in docs]}))
    numbers, query, term = {}, [], []
    for q, (_, text) in enumerate(items):
        for t in sorted(set(terms(text))):
            query.append(q)
            term.append(numbers.setdefault(t.encode(), len(numbers)))
    block = lexical_search.Block([i for i, _ in items], list(numbers), np.array(query), np.array(term))
    counts = [Counter(terms(t)) for _, t in docs]
    df = [sum(t.decode() in c for c in counts) for t in block.terms]
    total = sum(sum(c.values()) for c in counts)
    searcher = lexical_search.Searcher(block, lexical_search.weights(len(docs), df), len(docs), total, 10)
    m = lexical_search.norms(np.asarray(part.column("n")), len(docs), total)
    exact = searcher.exact(part, m) @ searcher.weights
    assert (searcher.bounds(part, m) >= exact).all()
    searcher.see(part)
    got = [(r["item_id"], r["doc_id"], r["score"]) for b in searcher.ranked() for r in b.to_pylist()]
    assert got == [(i, d, s) for i, _, d, s in sorted(model(docs, items), key=lambda r: r[:2])]
    assert searcher.n_scored < 0.4 * len(docs) * len(items)


def test_counts_beyond_a_cell(spark):
    docs = [(1, "a " * 5000 + "b"), (2, "a " * 255), (3, "a " * 254 + "c " * 300), (4, "d")]
    items = [(1, "a"), (2, "a c"), (3, "b d")]
    found, asked = frames(spark, docs, items)
    got = lexical_search.search(lexical_search.build_index(found), asked)
    assert sorted(map(tuple, got.collect()), key=str) == model(docs, items)


def test_edge_rows_and_empty_tables(spark):
    items = [(1, "the cat and the dog"), (2, "word5 and3"), (3, "日本語 ÜBUNG übung")]
    _, asked = frames(spark, [], items)
    docs = [(r[0], r[1]) for r in ROWS]
    got = lexical_search.search(lexical_search.build_index(documents(spark)), asked)
    assert sorted(map(tuple, got.collect()), key=str) == model(docs, items)
    assert lexical_search.search(lexical_search.build_index(empty(spark)), asked).count() == 0
    assert lexical_search.search(lexical_search.build_index(documents(spark)), asked.limit(0)).count() == 0


def test_the_registered_query(spark, tmp_path):
    docs, items = corpus(2, 60)
    found, asked = frames(spark, docs, items)
    found.write.parquet(f"{tmp_path}/documents.parquet")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op13_lexical_search"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == model(docs, items)
