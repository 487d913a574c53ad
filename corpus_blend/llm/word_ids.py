"""Token ids of many texts with the tokenizers library, one encoding per distinct word.

If a tokenizer's pre-tokenization never joins what white space separates and drops the white space
itself, a text's ids are the ids of its words in a row. Words of a corpus repeat, so a task
encodes each distinct word of a slice once and looks up the rest.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces of words whose ids a worker keeps; frequent ones are seen early.
MOST_CACHED = 300_000
# Letters that normalizing maps one to one, then marks that form one piece (no apostrophe: it may
# begin a piece with letters).
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte: printable Latin-1
    characters for themselves, all others the characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def words_apart(spec: dict) -> bool:
    """Whether the pre-tokenizer keeps only matches that hold no white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split = steps[0]
    shape = split.get("pattern", {}).get("Regex", "")
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in shape
        and r"\s" not in shape.replace(r"[^\s\p{L}\p{N}]+", "")
        and spec.get("post_processor") is None
        and not any(a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"])
    )


class WordEncoder:
    """Encodes slices of texts; made in a task from the tokenizer's JSON text."""

    _known: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, spec: str) -> WordEncoder:
        """The worker's own encoder for ``spec``, kept over tasks with the words it has seen."""
        if spec not in cls._known:
            cls._known = {spec: cls(spec)}
        return cls._known[spec]

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.apart = words_apart(parsed)
        lower = any(s.get("type") == "Lowercase" for s in (parsed.get("normalizer") or {}).get("normalizers", []))
        byte_level = any(
            s.get("type") == "ByteLevel" and not s.get("add_prefix_space")
            for s in (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [])
        )
        self.direct = self.apart and lower and byte_level and parsed["model"]["type"] == "BPE"
        self.letters = str.maketrans({b: c for b, c in byte_letters().items()})
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {"": b""}

    def word(self, word: str) -> bytes:
        """The ids of one word as unsigned 32-bit integers."""
        found = PLAIN.fullmatch(word) if self.direct else None
        if found:
            return self._piece(found[1].lower()) + self._piece(found[2])
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """One pre-token straight to the model; letters as their bytes' characters."""
        ids = self.parts.get(piece)
        if ids is None:
            visible = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(visible)]).tobytes()
            if len(self.parts) < MOST_CACHED:
                self.parts[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        if not self.apart:
            ids = [e.ids for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        places = np.asarray(words.offsets)
        coded = words.values[places[0] : places[-1]].dictionary_encode()
        distinct = [self.word(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        table = np.frombuffer(b"".join(distinct), np.uint32)
        begin = np.cumsum(size) - size
        chosen = np.asarray(coded.indices, dtype=np.int64)
        width = size[chosen]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        step = np.arange(total) - np.repeat(ends - width, width)
        ids = table[np.repeat(begin[chosen], width) + step]
        return ids, np.r_[0, ends][places[1:] - places[0]]
