"""The pipeline's stages on a small corpus with planted cases, each against plain Python."""

from __future__ import annotations

import random

import pytest
from test_dedup import components, line_model, simhash_model
from test_models import labelled, words
from test_tokens import ids_of

import corpus_pipeline
from corpus_blend.llm import toxicity
from corpus_blend.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts in lines, near copies, exact copies, a passage that many share."""
    rng = random.Random(3)
    rows = labelled(500, seed=2)
    lined = [("\n".join(" ".join(t.split()[i : i + 20]) for i in range(0, len(t.split()), 20))) for _, t, *_ in rows]
    passage = "\n".join(" ".join(words(rng, 18)) for _ in range(4))
    docs = [(r[0], t, "en", "s", len(t)) for r, t in zip(rows, lined, strict=True)]
    clean = [i for i, r in enumerate(rows) if not r[5] and len(lined[i]) > 900]
    docs += [(1000 + i, f"{' '.join(words(rng, 40))}\n{passage}\n{' '.join(words(rng, 9))}", "en", "s", 1) for i in range(5)]
    docs += [(2000 + i, docs[i][1].replace("\n", " ") + " end", "en", "s", 1) for i in clean[:6]]  # near copies, one line
    docs += [(3000 + i, docs[i][1], "en", "s", 1) for i in clean[:4]]  # exact copies
    docs += [(4000, None, None, None, None), (4001, "", "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame([(r[0], 0, r[5]) for r in rows], "doc_id bigint, quality int, toxic int")
    marks.write.parquet(f"{folder}/labels.parquet")
    return folder, docs, {r[0]: r[5] for r in rows}, passage


def test_stages(spark, corpus, tmp_path):
    folder, docs, toxic, passage = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "packing"] and corpus_pipeline.ORACLE_SQL is None
    frame, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, step in stages.items():
        result = step(spark, frame, folder)
        result.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = frame.collect()
        if name != "packing":
            assert frame.columns == COLUMNS

    # toxicity: the rows of the table as they were, all that score low
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    low = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), model).where("score < 0.5").collect()
    first = sorted((tuple(r) for r in kept["toxicity"]), key=str)
    assert {r[0] for r in first} == {r.id for r in low} and set(first) <= set(docs)
    known = [i for i in toxic if toxic[i] == (i not in {r[0] for r in first})]
    assert len(known) > 0.9 * len(toxic)

    # line dedup: as by all runs of all lengths
    model_rows = {i: t for i, t, _ in line_model(first, 50)}
    second = {r.doc_id: r for r in kept["line_dedup"]}
    assert {i: r.text for i, r in second.items()} == model_rows
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in second.values())
    holders = sorted(i for i in second if 1000 <= i < 1005)
    assert len(holders) > 1 and [passage in second[i].text for i in holders] == [True] + [False] * (len(holders) - 1)

    # SimHash: the smallest of each group
    prints = {i: simhash_model(t) for i, t in model_rows.items()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    smallest = components(ids, links)
    assert sorted(r.doc_id for r in kept["simhash"]) == [i for i in ids if smallest[i] == i]

    # packing: every id of every document once
    found = {}
    for p in sorted(kept["packing"], key=lambda p: (p.doc_id, p.start)):
        found[p.doc_id] = found.get(p.doc_id, b"") + p.ids
    want = {r.doc_id: ids_of(r.text, 2) for r in kept["simhash"]}
    assert {i: len(x) // 4 for i, x in found.items()} == {i: len(x) for i, x in want.items()}
    assert all([int.from_bytes(found[i][k : k + 4], "little") for k in range(0, len(found[i]), 4)] == want[i] for i in want)


def test_run_is_the_stages_in_a_row(spark, corpus, monkeypatch):
    """Each stage gets what the one before it returned, written and read again."""
    steps = [
        ("odd", lambda spark, docs, sf_dir: docs.where("doc_id % 2 = 1")),
        ("few", lambda spark, docs, sf_dir: docs.where("doc_id < 50")),
        ("count", lambda spark, docs, sf_dir: docs.groupBy().count()),
    ]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
    assert [tuple(r) for r in corpus_pipeline.run(spark, corpus[0]).collect()] == [(25,)]


def test_every_operator_has_a_query():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
