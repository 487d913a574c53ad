"""Token files, packing and SentencePiece coding: exact round trips and parity."""

from __future__ import annotations

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from frames import ROWS, documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_blend.llm import packing, sentence_pieces, simple8b
from corpus_blend.llm.queries import tokenizer_json
from corpus_blend.llm.word_ids import WordEncoder

ODD = [
    "", " ", "It's  á test<|endoftext|>x <|startoftext|> ", "Σας ΣΑΣ ΟΔΟΣ", "İstanbul ıI ﬁ", "日本語 テスト", "a b c\u0085d\x1ce",
    "don't,. !!?? a1b2", "µ ª º", "ÀÉÎ Über straße.,", "​ x", "é,è.", "!a", "A" * 3000, "é É.", "na_ïve_", "it'S WE'LL",
    "x'", "\x00 a", "word*** && (x)",
]


def word_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def ids_of(text, end):
    return [*word_tokenizer().encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def split(flat, ends):
    return [x.tolist() for x in np.split(flat, ends[:-1])]


def test_words_are_encoded_like_whole_texts():
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("abÉß.,'* \n日1_-") for _ in range(40)) for _ in range(500)]
    encoder = WordEncoder(tokenizer_json())
    assert encoder.apart and encoder.direct
    want = [e.ids for e in word_tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert split(*encoder.encode(pa.array(texts))) == want
    assert split(*encoder.encode(pa.array(texts).slice(3, 9))) == want[3:12]


def test_other_tokenizers_take_whole_texts():
    spec = tokenizer_json("byte_bpe_50k.json")
    encoder = WordEncoder(spec)
    assert not encoder.apart
    assert split(*encoder.encode(pa.array(ODD))) == [e.ids for e in Tokenizer.from_str(spec).encode_batch(ODD, add_special_tokens=False)]


# --- Simple-8b --------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 5, 119, 121, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("block", [7, 1024])
def test_simple8b_round_trip(n, block):
    rng = np.random.default_rng(n)
    for high in (1, 2, 300, 49408, 2**31, 2**60, 2**64 - 1):
        values = rng.integers(0, high, n, dtype=np.uint64)
        values[rng.random(n) < 0.3] = 0
        words, blocks = simple8b.encode(values, block)
        assert (simple8b.decode(words) == values).all() and len(blocks) == -(-n // block)
        file = io.BytesIO()
        simple8b.pack_file(file, [1], [n], [(words, blocks)], block)
        file.seek(0)
        read = simple8b.TokenFile(file)
        middle = len(blocks) // 2
        if n:
            assert (read.ids(middle, middle + 1) == values[middle * block :][:block]).all()


def test_words_hold_as_many_values_as_fit():
    words, _ = simple8b.encode(np.array([1] * 60 + [2**20 - 1] * 3 + [0] * 120 + [2**62], np.uint64))
    assert [int(w & np.uint64(15)) for w in words[:4]] == [2, 13, 1, 0] and len(words) == 5


def test_a_broken_file_is_an_error():
    file = io.BytesIO()
    simple8b.pack_file(file, [1], [3], [simple8b.encode(np.arange(3, dtype=np.uint64))], 1024)
    with pytest.raises(ValueError, match="breaks off"):
        simple8b.TokenFile(io.BytesIO(file.getvalue()[:-4])).ids()
    with pytest.raises(ValueError, match="not a file"):
        simple8b.TokenFile(io.BytesIO(b"x" * 100))


def test_token_files(spark, tmp_path):
    rows = ROWS
    folder = str(tmp_path / "tokens")
    files = simple8b.write_tokens(documents(spark, rows), tokenizer_json(), 1, folder, block=64, file_ids=1000)
    found = simple8b.read_tokens(spark, folder, files).collect()
    got = sorted(((r.id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found), key=lambda r: r[1])
    want, start = [], 0
    order = lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), r[1] or "")
    for i, text, *_ in sorted(rows, key=order):
        ids = ids_of(text, 1)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want and sum(r.documents for r in files.collect()) == len(rows)


def test_one_id_or_none_for_a_third_of_all_rows(spark, tmp_path):
    """Rows without an id come last and are spread over tasks like those of one id."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(600)]
    folder = str(tmp_path / "x")
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 600 rows would be one task's
    try:
        files = simple8b.write_tokens(frame, tokenizer_json(), 1, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() == 4 and files.agg(F.max("documents")).first()[0] < 200
    found = sorted(simple8b.read_tokens(spark, folder, files).collect(), key=lambda r: r.start)
    assert [r.id for r in found] == sorted((r[0] for r in rows if r[0] is not None)) + [None] * 200
    assert sorted(r.n_tokens for r in found) == sorted(len(ids_of(t, 1)) for _, t in rows)


def test_no_rows_give_no_token_files(spark, tmp_path):
    assert simple8b.write_tokens(empty(spark), tokenizer_json(), 1, str(tmp_path / "none")).count() == 0


# --- packing ----------------------------------------------------------------------------


def checked(pieces, examples, limits):
    """Every id of every example in one piece, sequences gapless and within their limits."""
    of, sequences = {}, {}
    for p in pieces:
        of.setdefault(p["id"], []).append((p["start"], p["ids"]))
        sequences.setdefault(p["sequence_id"], []).append(p)
    found = {i: b"".join(x for _, x in sorted(parts)) for i, parts in of.items()}
    assert found == {i: np.array(ids, "<u4").tobytes() for i, ids in examples.items() if len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [0, *np.cumsum([p["length"] for p in parts])[:-1]]
        assert sum(p["length"] for p in parts) <= limits.tokens and len(parts) <= limits.segments
        assert sum(p["loss_tokens"] for p in parts) <= limits.loss_tokens
        assert all(p["length"] == len(p["ids"]) // 4 > 0 for p in parts)
    return len(sequences)


def packed(examples, limits, masks=None):
    made = [packing.Example(i, np.array(x, np.uint32), None if masks is None else np.array(masks[i])) for i, x in examples.items()]
    return [r for b in packing.pack_examples(made, limits, 0) for r in b.to_pylist()]


def test_packing_without_padding():
    rng = random.Random(0)
    examples = {i: [rng.randrange(9) for _ in range(int(rng.expovariate(1 / 300)) + 1)] for i in range(3000)}
    n = checked(packed(examples, packing.Limits()), examples, packing.Limits())
    assert n == -(-sum(map(len, examples.values())) // 4096)


@pytest.mark.parametrize("limits", [packing.Limits(100, 3, 40, pool=8), packing.Limits(64, 64, 5), packing.Limits(1, 1, 1)])
def test_packing_under_three_limits(limits):
    rng = random.Random(1)
    examples = {i: [rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 30, 250]))] for i in range(200)}
    masks = {i: [rng.random() < 0.4 for _ in x] for i, x in examples.items()}
    checked(packed(examples, limits, masks), examples, limits)


def test_packing_that_cannot_work_is_an_error():
    with pytest.raises(ValueError, match="loss_tokens"):
        packed({1: [1, 2]}, packing.Limits(loss_tokens=0))
    with pytest.raises(ValueError, match="needs room"):
        packing._checked(packing.Limits(tokens=0))


def test_pack_documents(spark):
    rows = [r for r in ROWS if r[0] != 9]
    got = [r.asDict() for r in packing.pack_documents(documents(spark, rows), tokenizer_json(), 2).collect()]
    checked(got, {r[0]: ids_of(r[1], 2) for r in rows}, packing.Limits())
    assert packing.pack_documents(empty(spark), tokenizer_json(), 2).count() == 0


def test_repeated_ids_are_examples_of_their_own(spark):
    rows = spark.createDataFrame([(1, b"\1\0\0\0", None), (1, b"\1\0\0\0", b"\0"), (2, None, None)], "id bigint, ids binary, loss_mask binary")
    got = packing.pack(rows.coalesce(1)).collect()
    assert sorted((r.id, r.offset, r.loss_tokens) for r in got) in ([(1, 0, 0), (1, 1, 1)], [(1, 0, 1), (1, 1, 0)])


def test_pack_conversations(spark):
    turns = [(1, 1, "assistant", "the answer"), (1, 0, "user", "a question"), (2, 0, None, None), (2, 1, "assistant", None)]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.id: r for r in packing.pack_conversations(rows, tokenizer_json(), 2).collect()}
    assert np.frombuffer(got[1].ids, "<u4").tolist() == ids_of("a question", 2) + ids_of("the answer", 2)
    assert got[1].loss_tokens == len(ids_of("the answer", 2)) and got[2].length == 2 and got[2].loss_tokens == 1


# --- SentencePiece ----------------------------------------------------------------------


def piece_model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def arrays(found):
    return [np.frombuffer(x, "<u4").tolist() for x in found]


SPACED = ["  lead", "a  b", "trail   ", "a\tb\n\nc", "<s> </s> <unk> <0x41>", "▁x▁ y", "x" + " " * 40 + "y", "Ωμέγα ὀ", "🤷🏽‍♂️"]


def test_bpe_parity_and_round_trip():
    rng = random.Random(2)
    texts = ODD + SPACED + ["".join(rng.choice("ab c  \né▁你.") for _ in range(50)) for _ in range(400)]
    exact = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    coder = sentence_pieces.Coder(piece_model())
    want = exact.encode(texts)
    assert coder.apart and arrays(coder.encode(pa.array(texts))) == want
    assert arrays(coder.encode(pa.array(texts))) == want  # now from the cache
    assert coder.decode([np.array(x, np.int64) for x in want]) == exact.decode(want)


def test_decoding_is_the_librarys():
    """Byte pieces that are no whole characters among them."""
    coder = sentence_pieces.Coder(piece_model())
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 300 if i % 2 else 32_000, rng.integers(0, 30)) for i in range(300)]
    exact = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    rows += [np.array(exact.encode(t), np.int64) for t in ODD + SPACED] + [np.array([1, 2, 259]), np.array([0, 13])]
    want = coder.tokenizer.decode_batch([r[~coder.hidden[r]].tolist() for r in rows], skip_special_tokens=False)
    assert coder.decode(rows) == want and coder.decode([]) == []
    with pytest.raises(IndexError):
        coder.decode([np.array([32_000])])


def message(*parts):
    """A protobuf message of ``(number, value)``: whole numbers, floats, bytes."""
    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        for n in ((number << 3 | (2 if isinstance(value, bytes) else 0)), len(value) if isinstance(value, bytes) else value):
            while n > 127:
                out += bytes([n & 127 | 128])
                n >>= 7
            out += bytes([n])
        out += value if isinstance(value, bytes) else b""
    return out


def unigram_model(byte_fallback, extra_spaces):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    own = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁b", "ca", "▁c", "é", "\n", "."]
    pieces += [(p, -1.5 - 0.37 * i, 1) for i, p in enumerate(own)]
    trainer = message((3, 1), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2), (43, (1 << 64) - 1))
    normalizer = message((1, b"identity"), (2, b""), (3, 1), (4, int(extra_spaces)), (5, 1))
    coded = [(1, message((1, p.encode()), (2, s), (3, kind))) for p, s, kind in pieces]
    return message(*coded, (2, trainer), (3, normalizer))


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("extra_spaces", [True, False])
def test_unigram_parity(byte_fallback, extra_spaces):
    data = unigram_model(byte_fallback, extra_spaces)
    rng = random.Random(3)
    texts = ["", " ", "  abc  ab ", "你", "x"] + ["".join(rng.choice("abc  é\n.") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += ["ab 你好 ca"] * byte_fallback
    exact = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert arrays(sentence_pieces.Coder(data).encode(pa.array(texts))) == exact.encode(texts)


def test_sentence_pieces_in_spark(spark):
    encoded = sentence_pieces.encode(documents(spark), piece_model(), verify=True)
    got = sorted(((r.id, r.n_tokens, r.text) for r in sentence_pieces.decode(encoded, piece_model()).collect()), key=str)
    exact = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    assert got == sorted(((r[0], len(exact.encode(r[1] or "")), r[1] or "") for r in ROWS), key=str)
    assert sentence_pieces.encode(empty(spark), piece_model()).count() == 0


def test_broken_models_are_errors():
    with pytest.raises(ValueError):
        sentence_pieces.Model.parse(piece_model()[:-3])
