"""SentencePiece models by the tokenizers library: encoding and decoding of whole texts.

The model file is parsed as the protobuf message it is, and its tokenizer rebuilt from the parts:
normalizer, the mark for spaces, scores (unigram) or the merges that scores imply (BPE), and byte
fallback. Where no piece of the model goes on after a space, a text's ids are the ids of its
stretches between spaces in a row, so a task encodes each distinct stretch once, in one
multithreaded batch, and can hold it against the SentencePiece library as well.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from corpus_blend.llm.common import id_and_text, text_slices

SPACE = "▁"
# Fixed values of the format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
MOST_CACHED = 100_000
#: Stretches encoded in one call, whose results take far more room than their ids.
BATCH = 16_384


def fields(message: bytes):
    """``number, value`` of each field of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"no protobuf message: field of kind {kind} at {at}")
        size = {1: 8, 5: 4}.get(kind) or varint()
        if at + size > len(message):
            raise ValueError("the protobuf message breaks off")
        yield key >> 3, message[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says; the defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    space_as_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        found = cls()
        for number, value in fields(data):
            if number == 1:
                part = dict(fields(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                found.pieces.append((part[1].decode(), score, part.get(3, NORMAL)))
            elif number == 2:
                part = dict(fields(value))
                found.kind = part.get(3, UNIGRAM)
                found.space_as_suffix = bool(part.get(24, 0))
                found.byte_fallback = bool(part.get(35, 0))
            elif number == 3:
                part = dict(fields(value))
                found.charsmap = part.get(2, b"")
                found.dummy_prefix = bool(part.get(3, 1))
                found.remove_extra_spaces = bool(part.get(4, 1))
                found.escape_spaces = bool(part.get(5, 1))
        if found.kind not in (UNIGRAM, BPE) or found.space_as_suffix or not found.escape_spaces:
            raise ValueError("only unigram and BPE models that mark spaces in front are supported")
        return found

    def merges(self) -> list[tuple[str, str]]:
        """Each way to put a piece together from two; the better the piece's score, the earlier."""
        score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        rank = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        ways = [
            (-s, rank[p], rank[p[:i]], rank[p[i:]], p[:i], p[i:])
            for p, s in score.items()
            for i in range(1, len(p))
            if p[:i] in score and p[i:] in score
        ]
        return [way[4:] for way in sorted(ways)]

    def tokenizer(self) -> Tokenizer:
        unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(
                vocabulary, self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True,
                byte_fallback=self.byte_fallback,
            )
        else:
            # What texts must not match by its letters gets a score that no path takes.
            worst = min(s for _, s, _ in self.pieces) - 1e6
            scored = [(p, s if kind in (NORMAL, USER_DEFINED) else worst) for p, s, kind in self.pieces]
            model = models.Unigram(scored, unknown, self.byte_fallback)
        built = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra_spaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        built.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        after = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        built.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *after])
        own = [p for p, _, kind in self.pieces if kind == USER_DEFINED]
        if own:
            built.add_tokens([AddedToken(p, normalized=False) for p in own])
        return built

    def stretches_apart(self) -> bool:
        """Whether texts can be cut in front of every space."""
        return (
            not self.charsmap
            and not self.remove_extra_spaces
            and self.dummy_prefix
            and not any(kind == USER_DEFINED for _, _, kind in self.pieces)
            and not any(SPACE in p.lstrip(SPACE) for p, _, _ in self.pieces)
        )


class Coder:
    """Encodes and decodes slices of texts in a task; a worker keeps it over its tasks."""

    _known: dict = {}

    @classmethod
    def of(cls, data: bytes, threads: int = 1, verify: bool = False) -> Coder:
        key = (hash(data), threads, verify)
        if key not in cls._known:
            cls._known = {key: cls(data, threads, verify)}
        return cls._known[key]

    def __init__(self, data: bytes, threads: int = 1, verify: bool = False):
        # Read by the library's thread pool when it first starts in this process.
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        model = Model.parse(data)
        self.tokenizer = model.tokenizer()
        self.apart = model.stretches_apart()
        self.exact = sentencepiece.SentencePieceProcessor(model_proto=data) if verify else None
        self.dummy_prefix = model.dummy_prefix
        self.hidden = np.array([kind == CONTROL for _, _, kind in model.pieces])
        shown = [_bytes_of(p, kind) for p, _, kind in model.pieces]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown])
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [ids for at in range(0, len(texts), BATCH) for ids in self._some_ids(texts[at : at + BATCH])]

    def _some_ids(self, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.exact is not None:
            for text, ids, wanted in zip(texts, found, self.exact.encode(texts, num_threads=1), strict=True):
                if ids != wanted:
                    raise ValueError(f"the libraries disagree on {text[:200]!r}: {ids[:20]} and {wanted[:20]}")
        return [np.array(ids, "<u4").tobytes() for ids in found]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.apart or not len(texts):
            return self._ids(texts.to_pylist())
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        places = np.asarray(cut.offsets)
        coded = cut.values[places[0] : places[-1]].dictionary_encode()
        number = np.asarray(coded.indices, np.int64)
        stretches = coded.dictionary.to_pylist()
        new = [s for s in stretches if s and SPACE not in s and s not in self.cache]
        fresh = dict(zip(new, self._ids(new), strict=True))
        # An empty stretch is a space next to a space, or none at all, and the mark itself may stand
        # in a text: such texts go whole.
        table = [self.cache.get(s) or fresh.get(s, b"") for s in stretches]
        size = np.fromiter(map(len, table), np.int64, len(table))
        ends = np.cumsum(size[number])
        data = np.frombuffer(b"".join(table), "<u4")
        begin = (np.cumsum(size) - size) // 4
        width = size[number] // 4
        total = int(width.sum())
        ids = data[np.repeat(begin[number], width) + np.arange(total) - np.repeat(ends // 4 - width, width)].tobytes()
        edges = np.r_[0, ends][places - places[0]]
        found = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        spaced = np.r_[0, np.cumsum(size[number] == 0)][places - places[0]]
        whole = np.flatnonzero(np.diff(spaced))
        if len(whole):
            for i, own in zip(whole.tolist(), self._ids(texts.take(pa.array(whole)).to_pylist()), strict=True):
                found[i] = own
        if len(self.cache) < MOST_CACHED:
            self.cache |= fresh
        return found

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each row of ids; control pieces have none.

        The pieces' bytes are put in a row. Where byte pieces are no whole characters, the library's
        decoder says what is shown for them.
        """
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        size = self.shown_size[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.shown[np.repeat(self.shown_at[flat] - (ends - size), size) + np.arange(total)].tobytes()
        edges = np.r_[0, ends][np.cumsum([0, *map(len, ids)])].tolist()
        texts: list[str] = []
        for row, a, b in zip(ids, edges[:-1], edges[1:], strict=True):
            try:
                texts.append(data[a + (self.dummy_prefix and data[a : min(a + 1, b)] == b" ") : b].decode())
            except UnicodeDecodeError:
                texts.append(self.tokenizer.decode(row[~self.hidden[row]].tolist(), skip_special_tokens=False))
        return texts


def _bytes_of(piece: str, kind: int) -> bytes:
    if kind == CONTROL:
        return b""
    return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(SPACE, " ").encode()


def encode(
    df: DataFrame,
    model: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    threads: int = 2,
    verify: bool = False,
) -> DataFrame:
    """``id, n_tokens, ids`` (little-endian unsigned 32-bit, in a binary) of every whole text.

    ``model`` is the content of a SentencePiece model file. ``verify`` encodes all that a worker
    sees for the first time by the SentencePiece library too; a difference is an error. A null
    text is empty and has no ids; repeated rows have equal ids; other columns are not looked at. No rows
    give no rows. Long texts are encoded whole; those above 4 MB each have a slice to themselves.

    ``threads`` of the library's pool encode a batch in each worker; set it to ``spark.task.cpus``
    where that is more than two.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder = Coder.of(shared.value, threads, verify)
        for batch in batches:
            for part in text_slices(batch, most_bytes=4 << 20):
                found = coder.encode(part.column("text"))
                counts = pa.array([len(x) // 4 for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), counts, pa.array(found, pa.binary())], names=["id", "n_tokens", "ids"]
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id bigint, n_tokens bigint, ids binary")


def decode(df: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """``id, n_tokens, ids, text`` of rows as ``encode`` returns them; null ids have the text "", and
    no rows give no rows.

    An id that the model doesn't have is an error. Spaces come back as spaces; what the model's
    normalizer changed does not come back.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder = Coder.of(shared.value, threads)
        for batch in batches:
            for part in text_slices(batch, "ids"):
                ids = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4") for x in part.column("ids")]
                texts = pa.array(coder.decode(ids), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["id", "n_tokens", "ids", "text"])

    return df.select("id", "n_tokens", "ids").mapInArrow(run, "id bigint, n_tokens bigint, ids binary, text string")
