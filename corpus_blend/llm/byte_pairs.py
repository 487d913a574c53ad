"""Byte-level BPE: texts to token ids and back, with the merging done here.

A word begins as the ids of its bytes, next to the ranks of its neighbouring pairs. Over and over the
lowest rank (the first of equal ones) is looked for, the boundary between its two parts is deleted, and
the ranks to either side are looked up anew. Short words of one length share two contiguous arrays, a
word a row, so each round scans, deletes and refreshes all of them at once and every row has lost one
part when it ends. Long words, whose rounds would cost their length each, keep their pairs in a heap.

Texts are cut before every space that follows something else than white space. The pre-tokenizer never
joins what lies on both sides of such a cut, and what lies between two cuts repeats, so a task works out
each distinct stretch of a slice once.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from corpus_blend.llm.common import id_and_text, text_slices
from corpus_blend.llm.word_ids import byte_letters

#: Bytes of the longest word that is merged in the arrays; longer ones take the heap.
SHORT = 48
#: Fewer words of one length than this are not worth arrays of their own.
FEW = 6
#: Stretches whose ids a worker keeps.
MOST_CACHED = 400_000
#: The rank of a pair that never merges.
NEVER = np.int32(2**31 - 1)
#: Fixed value: how byte-level pre-tokenizers of this family cut texts into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))
#: Fixed value: white space that is more than one byte long.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class PairCoder:
    """Encodes and decodes; made in a task from the tokenizer's JSON text."""

    _known: dict[str, PairCoder] = {}

    @classmethod
    def of(cls, spec: str) -> PairCoder:
        """The worker's own coder for ``spec``, kept over tasks with the stretches it has seen."""
        if spec not in cls._known:
            cls._known = {spec: cls(spec)}
        return cls._known[spec]

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        _check(parsed)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocabulary = parsed["model"]["vocab"]
        special = {a["content"]: a["id"] for a in parsed["added_tokens"]}
        content = {i: bytes(byte_of[c] for c in piece) for piece, i in vocabulary.items()}
        content |= {i: text.encode() for text, i in special.items()}
        most = max(content) + 1
        size = np.array([len(content.get(i, b"")) for i in range(most)], np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(content.get(i, b"") for i in range(most)), np.uint8)

        self.single = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        pairs = {}
        for rank, merge in enumerate(parsed["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[vocabulary[a] << 32 | vocabulary[b]] = (rank, vocabulary[a + b])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged_of_rank = np.zeros(len(parsed["model"]["merges"]), np.int32)
        for rank, merged in pairs.values():
            self.merged_of_rank[rank] = merged

        # Longest first where one begins another, as the first that matches is taken.
        names = sorted(special, key=len, reverse=True)
        self.special = {n.encode(): array("I", [special[n]]).tobytes() for n in names}
        self.special_at = regex.compile("(" + "|".join(regex.escape(n) for n in names) + ")") if names else None
        self.words = regex.compile(WORDS)
        # The library's own idea of letters, numbers and white space is asked character by character;
        # texts with one that this module's pattern sees differently are cut by the library.
        self.library = Tokenizer.from_str(spec).pre_tokenizer
        self.kinds = [(kind, regex.compile(pattern)) for kind, pattern in KINDS]
        self.asked: set[str] = set()
        self.odd: set[str] = set()
        self._ask({chr(i) for i in range(128)})
        self.solid = np.ones(256, bool)
        for i in range(128):
            self.solid[i] = self._library_kind(chr(i)) != "S"
        self.known: dict[bytes, bytes] = {}

    # --- cutting -----------------------------------------------------------------------

    def _library_kind(self, c: str) -> str:
        joins = lambda x: len(self.library.pre_tokenize_str(x + c)) == 1
        return "L" if joins("a") else "N" if joins("1") else "O" if joins("!") else "S"

    def _ask(self, characters: set[str]) -> None:
        for c in characters - self.asked:
            here = next((kind for kind, pattern in self.kinds if pattern.match(c)), "O")
            if here != self._library_kind(c):
                self.odd.add(c)
        self.asked |= characters

    def _words(self, text: str) -> list[bytes]:
        """What the pre-tokenizer makes of a text without special tokens."""
        if self.odd and not self.odd.isdisjoint(text):
            return [text[a:b].encode() for _, (a, b) in self.library.pre_tokenize_str(text)]
        return [w.encode() for w in self.words.findall(text)]

    def _parts(self, stretch: bytes) -> list[bytes]:
        """The words and special tokens of a stretch."""
        text = stretch.decode("utf-8", "replace")
        if not text.isascii():
            self._ask(set(text))
        if self.special_at is None or not self.special_at.search(text):
            return self._words(text)
        found = []
        for i, part in enumerate(self.special_at.split(text)):
            found += [part.encode()] if i % 2 else self._words(part)
        return found

    def _stretches(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts in a row, and where each text's stretches end."""
        wide = np.asarray(pc.match_substring_regex(texts, WIDE_SPACE)) if len(texts) else np.zeros(0, bool)
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        cut = np.zeros(len(body), bool)
        cut[1:] = (body[1:] == 0x20) & self.solid[body[:-1]]
        if wide.any():  # the byte before may then be the end of a wide white space
            cut[1:] &= ~(np.repeat(wide, np.diff(offsets))[1:] & (body[:-1] >= 0x80))
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        edges = np.flatnonzero(cut)
        bounds = np.r_[edges, len(body)].astype(np.int64)
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(body)]
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges), buffers)
        return stretches, np.searchsorted(edges, offsets[1:])

    # --- merging -----------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[place] == pair, self.rank[place], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as unsigned 32-bit integers in bytes."""
        found: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, places in by_length.items():
            if length > SHORT or len(places) < FEW:
                for i in places:
                    found[i] = self._merge_long(words[i])
            elif length:
                self._merge_short([words[i] for i in places], places, found)
        return found

    def _merge_short(self, words: list[bytes], places: list[int], found: list[bytes]) -> None:
        """All words of one length: a row of part ids and a row of adjacent ranks each."""
        rows = np.array(places)
        parts = self.single[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            lowest = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[each, lowest] if ranks.shape[1] else np.full(len(rows), NEVER)
            over = least == NEVER
            if over.any():
                for i, ids in zip(rows[over].tolist(), parts[over].astype("<u4"), strict=True):
                    found[i] = ids.tobytes()
                going = ~over
                rows, parts, ranks, lowest, least = rows[going], parts[going], ranks[going], lowest[going], least[going]
                each = np.arange(len(rows))
                if not len(rows):
                    return
            parts[each, lowest] = self.merged_of_rank[least]
            width = parts.shape[1]
            stay = np.arange(width) != lowest[:, None] + 1  # the boundary after the lowest goes
            parts = parts[stay].reshape(len(rows), width - 1)
            ranks = ranks[np.arange(width - 1) != lowest[:, None]].reshape(len(rows), width - 2)
            before = np.flatnonzero(lowest > 0)
            ranks[before, lowest[before] - 1] = self._ranks(parts[before, lowest[before] - 1], parts[before, lowest[before]])
            after = np.flatnonzero(lowest < width - 2)
            ranks[after, lowest[after]] = self._ranks(parts[after, lowest[after]], parts[after, lowest[after] + 1])

    def _merge_long(self, word: bytes) -> bytes:
        """One word of any length: a heap of pairs over linked parts."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs, waiting = self.pairs, []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n:
                found = pairs.get(ids[i] << 32 | ids[j])
                if found:
                    heapq.heappush(waiting, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, left, right, merged = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two is part of something else by now
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return array("I", [x for x in ids if x >= 0]).tobytes()

    # --- texts -------------------------------------------------------------------------

    def _ids(self, stretches: list[bytes]) -> list[bytes]:
        """The ids of stretches, each distinct word of which is merged once."""
        parts = [self._parts(s) for s in stretches]
        words = [w for w in dict.fromkeys(w for found in parts for w in found) if w not in self.special]
        ids = self.special | dict(zip(words, self.merge(words), strict=True))
        return [b"".join([ids[w] for w in found]) for found in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        stretches, upto = self._stretches(texts)
        coded = stretches.dictionary_encode()
        known = self.known
        table = [known.get(s) for s in coded.dictionary.to_pylist()]
        fresh = [i for i, ids in enumerate(table) if ids is None]
        new = coded.dictionary.take(pa.array(fresh, pa.int64())).to_pylist()
        for i, ids in zip(fresh, self._ids(new), strict=True):
            table[i] = ids
        if len(known) < MOST_CACHED:  # what is frequent is seen early
            known.update((s, table[i]) for s, i in zip(new, fresh, strict=True) if len(s) <= SHORT)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), np.uint32)
        begin = np.cumsum(size) - size
        chosen = np.asarray(coded.indices, dtype=np.int64)
        width = size[chosen]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[chosen] - (ends - width), width) + np.arange(total)]
        return ids, np.r_[0, ends][upto]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each row of ids; bytes that are no whole character show as U+FFFD."""
        ids = ids.astype(np.int64)
        ids[ids >= len(self.size)] = len(self.size)
        size = np.r_[self.size, 0][ids]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        data = self.bytes[np.repeat(np.r_[self.at, 0][ids] - (upto - size), size) + np.arange(total)].tobytes()
        edges = np.r_[0, upto][np.r_[0, ends]].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _check(parsed: dict) -> None:
    """Only what this module does the same way as the library is taken."""
    model, cutter = parsed["model"], parsed.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and cutter.get("type") == "ByteLevel"
        and cutter.get("use_regex", True)
        and not cutter.get("add_prefix_space")
        and parsed.get("normalizer") is None
        and (parsed.get("decoder") or {}).get("type") == "ByteLevel"
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in parsed["added_tokens"])
        and not any(regex.search(r"\s", a["content"]) for a in parsed["added_tokens"])
    )
    if not plain:
        raise ValueError("only byte-level BPE tokenizers without normalizer, prefix space or stripping tokens")


def encode(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids`` (little-endian unsigned 32-bit, in a binary) of every whole text.

    ``spec`` is a tokenizer's JSON text; truncation and padding in it are not used, and special tokens
    that stand in a text are encoded as such, as the library does. A null or empty text has no ids; a
    text may be of any length; repeated rows have equal ids; no rows give none; other columns are not
    looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        coder = PairCoder.of(shared.value)
        for batch in batches:
            for part in text_slices(batch, most_bytes=4 << 20):
                ids, ends = coder.encode(part.column("text"))
                counts = np.diff(ends, prepend=0)
                data = pa.py_buffer(ids.astype("<u4", copy=False))
                bounds = pa.py_buffer((np.r_[0, ends] * 4).astype(np.int64))
                found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, bounds, data])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts, pa.int64()), found.cast(pa.binary())], names=["id", "n_tokens", "ids"]
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id bigint, n_tokens bigint, ids binary")


def decode(df: DataFrame, spec: str) -> DataFrame:
    """``id, n_tokens, ids, text`` of rows as ``encode`` returns them; null or empty ids have the text "".

    Special tokens show as their text; an id that the vocabulary lacks shows as nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        coder = PairCoder.of(shared.value)
        for batch in batches:
            for part in text_slices(batch, "ids"):
                rows = part.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(x or b"" for x in rows), "<u4")
                ends = np.cumsum(np.fromiter((len(x or b"") // 4 for x in rows), np.int64, len(rows)))
                texts = pa.array(coder.decode(ids, ends), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["id", "n_tokens", "ids", "text"])

    return df.select("id", "n_tokens", "ids").mapInArrow(run, "id bigint, n_tokens bigint, ids binary, text string")
