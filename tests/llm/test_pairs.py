"""Byte-level BPE against its library: words, texts, files' edge cases, the registered query."""

from __future__ import annotations

import hashlib
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from frames import ROWS, documents, empty
from test_tokens import ODD
from tokenizers import Tokenizer

from corpus_blend.llm import byte_pairs
from corpus_blend.llm.queries import QUERIES, tokenizer_json

SPEC = tokenizer_json("byte_bpe_50k.json")
MORE = [
    "a\n  b", "a \n\n b", "x \t y", "   ", "\n\n", "end  ", "  begin", "a   b    c", "<|endoftext|>", " \n<|endoftext|> \n", "a<|endoftext|>  b",
    "we'll they've I'M it's 'd", "١٢٣ ²½ Ⅻ", "a　 b", "a  b", "é  è", "  x", "🤷🏽‍♂️ ok", "a" * 3000, " " * 500 + "x", "\U000323af \U0001fae8",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(SPEC)


def test_texts_like_the_library(library):
    rng = random.Random(5)
    signs = [*"abcdeÉßñ.,'* \n\t\r1_-日🤷　\u0085 ²½", "<|endoftext|>", "'ll", " the", "  "]
    texts = ODD + MORE + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(30)) for _ in range(500)]
    coder = byte_pairs.PairCoder(SPEC)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from what is kept
        ids, ends = coder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert coder.decode(ids, ends) == [library.decode(x, skip_special_tokens=False) for x in want] == texts
    ids, ends = coder.encode(pa.array(texts).slice(7, 20))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want[7:27]


def test_broken_characters_decode_like_the_library(library):
    rng = random.Random(6)
    rows = [[rng.randrange(50300) for _ in range(12)] for _ in range(500)]
    found = byte_pairs.PairCoder(SPEC).decode(np.array(rows, np.uint32).ravel(), np.cumsum([12] * 500))
    assert found == [library.decode(r, skip_special_tokens=False) for r in rows]


def test_arrays_and_heap_merge_alike():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdethe inñ日") for _ in range(rng.randint(1, 16))).encode() for _ in range(3000)]
    coder = byte_pairs.PairCoder(SPEC)
    assert coder.merge(words) == [coder._merge_long(w) for w in words]
    assert coder.merge([]) == []


def test_other_tokenizers_are_refused():
    parsed = json.loads(SPEC)
    parsed["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="byte-level"):
        byte_pairs.PairCoder(json.dumps(parsed))
    with pytest.raises(ValueError, match="byte-level"):
        byte_pairs.PairCoder(tokenizer_json("word_bpe_49k.json"))


def test_edge_rows(spark, library):
    found = byte_pairs.decode(byte_pairs.encode(documents(spark), SPEC), SPEC).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in ROWS]
    got = [(r.id, list(struct.unpack(f"<{r.n_tokens}I", r.ids)), r.text) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert byte_pairs.decode(byte_pairs.encode(empty(spark), SPEC), SPEC).count() == 0


def test_the_registered_query(spark, library, tmp_path):
    rows = ROWS + [(100 + i, t, "en", "a", 1) for i, t in enumerate(MORE)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_byte_pairs"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
