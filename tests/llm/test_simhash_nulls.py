"""SimHash fingerprints that only rows without an id hold."""

from __future__ import annotations

from corpus_blend.llm import simhash


def test_a_row_without_an_id_joins_two_others(spark):
    rows = [(7, 0), (None, 0b1111), (3, 0b11111111), (None, 1 << 60 | 0xFFF << 20)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "id bigint, fingerprint bigint")).collect()
    assert sorted(((r.id, r.component) for r in found), key=str) == [(3, 3), (7, 3), (None, 3), (None, None)]


def test_rows_go_by_id_and_text(spark):
    """A near copy goes, another text under the same id stays, copies without an id go with the rest."""
    words = [f"word{i}" for i in range(400)]
    text, other = " ".join(words), " ".join(reversed([f"else{i}" for i in range(300)]))
    rows = [
        (1, text, "a"), (2, text + " end", "b"), (2, other, "c"), (3, text, "d"), (3, text, "d"), (None, text, "e"),
        (None, "only here " + other, "f"), (None, None, "g"), (5, other + " end", "h"), (7, "x y z", "i"), (7, "x y z", "j"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == ["doc_id", "text", "mark"]
    prints = [simhash.simhash((t or "").encode()) for _, t, _ in rows]
    near = lambda a, b: (a ^ b).bit_count() <= 4
    assert near(prints[0], prints[1]) and near(prints[2], prints[8]) and not near(prints[0], prints[2])
    gone = {"b", "d", "e", "h"} | ({"f"} if near(prints[6], prints[2]) else set())
    assert sorted(r.mark for r in kept.collect()) == sorted({r[2] for r in rows} - gone)
    assert simhash.drop_near_duplicates(frame.limit(0)).count() == 0
