"""Registered queries without SQL, whole, against plain Python on a small folder."""

from __future__ import annotations

import struct
import zlib
from itertools import combinations

import pytest
from frames import ROWS, documents
from test_dedup import simhash_model
from tokenizers import Tokenizer

from corpus_blend.llm.queries import QUERIES, tokenizer_json

MORE = [
    (11, "The cat sat on the mat, and the dog slept beside it.", "en", "a", 1),
    (12, "THE CAT sat on the mat, and the dog slept beside it.", "en", "a", 1),
    (-4, "one", "en", "a", 3),
    (1 << 40, "one two", "en", "a", 7),
]
UNIQUE = [r for r in ROWS if r[0] not in (None, 9)] + MORE


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    documents(spark, UNIQUE).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_str(tokenizer_json())
    return {i: library.encode(text or "", add_special_tokens=False).ids for i, text, *_ in UNIQUE}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op4_simhash(spark, folder):
    prints = {i: simhash_model(text) for i, text, *_ in UNIQUE}
    root = {i: i for i in prints}
    for _ in prints:  # as many rounds as any chain is long
        for a, b in combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    got = QUERIES["op4_simhash"](spark, folder).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", root[i]) for i, p in prints.items())


def test_op5_token_files(spark, folder, ids_of):
    want, start = [], 0
    for i in sorted(ids_of):
        ids = [*ids_of[i], 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = QUERIES["op5_token_files"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op6_packing(spark, folder, ids_of):
    got = QUERIES["op6_packing"](spark, folder).collect()
    reached = dict.fromkeys(ids_of, 0)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = [*ids_of[r.doc_id], 2]
        assert (r.start, r.doc_tokens) == (reached[r.doc_id], len(ids)) and r.length > 0
        reached[r.doc_id] += r.length
        assert r.ids_crc32 == crc(ids[r.start : reached[r.doc_id]])
    assert reached == {i: len(ids) + 1 for i, ids in ids_of.items()}
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
