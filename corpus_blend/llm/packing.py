"""Packing of training examples into sequences under several limits at once.

Vector bin packing with the dot-product heuristic (Panigrahy et al., "Heuristics for Vector Bin
Packing", 2011): a sequence has room for tokens, segments and loss-bearing tokens, an example needs
some of each, and the next example placed is the one whose needs point most in the direction of
the room that is left. Only when none fits as a whole is one cut to fill the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import id_and_text, text_slices
from corpus_blend.llm.word_ids import WordEncoder

PIECES = (
    "id bigint, start bigint, length bigint, ids binary, example_tokens bigint, loss_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_ARROW = pa.schema(
    [(c, pa.binary() if c == "ids" else pa.int64()) for c in (x.split()[0] for x in PIECES.split(", "))]
)
#: Sequences of one task; a sequence id is the task's number and the sequence's place in it.
PER_TASK = 1 << 40


@dataclass(frozen=True)
class Limits:
    """What a sequence has room for, and what a task looks at when it chooses an example."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096
    pool: int = 2048
    pool_tokens: int = 4 << 20


class Example:
    """An example of which the ids from ``start`` on are still to be placed."""

    __slots__ = ("id", "ids", "loss", "start")

    def __init__(self, row, ids: np.ndarray, mask: np.ndarray | None):
        self.id, self.ids, self.start = row, ids, 0
        # loss[i]: loss-bearing ids before i; all of them if no mask says otherwise
        self.loss = None if mask is None else np.r_[0, np.cumsum(mask != 0)]

    def needs(self) -> tuple[int, int]:
        left = len(self.ids) - self.start
        return left, left if self.loss is None else int(self.loss[-1] - self.loss[self.start])

    def cut(self, tokens: int, loss_tokens: int) -> int:
        """How many ids fit into the room."""
        n = min(tokens, len(self.ids) - self.start)
        if self.loss is None:
            return min(n, loss_tokens)
        most = self.loss[self.start] + loss_tokens
        return min(n, int(np.searchsorted(self.loss, most, side="right")) - 1 - self.start)


class Pool:
    """Examples to choose from, with their needs in arrays."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.items: list[Example] = []
        self.needs = np.zeros((3, 2 * limits.pool), np.float64)
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.tokens = 0

    def add(self, item: Example):
        n = len(self.items)
        if n == self.needs.shape[1]:
            self.needs = np.concatenate((self.needs, np.zeros_like(self.needs)), axis=1)
        self.items.append(item)
        self._measure(n)
        self.tokens += len(item.ids)

    def _measure(self, at: int):
        tokens, loss = self.items[at].needs()
        self.needs[:, at] = tokens, 1, loss

    def best(self, room: np.ndarray) -> tuple[int, bool]:
        """The example to place next, and whether it fits as a whole; -1 if nothing can be placed."""
        needs = self.needs[:, : len(self.items)]
        # One weight per limit: room and needs are both taken as shares of the capacity.
        score = (room / np.maximum(self.capacity, 1) ** 2) @ needs
        fits = (needs <= room[:, None]).all(axis=0)
        if fits.any():
            return int(np.argmax(np.where(fits, score, -1.0))), True
        if room[0] < 1 or room[1] < 1:
            return -1, False
        if room[2] >= 1:
            return int(np.argmax(score)), False
        for at, item in enumerate(self.items):  # only ids without loss can still be placed
            if item.cut(int(room[0]), 0):
                return at, False
        return -1, False

    def take(self, at: int, n: int) -> tuple[Example, int]:
        """Take ``n`` ids of an example, which stays if it has more."""
        item = self.items[at]
        start, item.start = item.start, item.start + n
        if item.start == len(item.ids):
            last = len(self.items) - 1
            self.items[at] = self.items[last]
            self.needs[:, at] = self.needs[:, last]
            self.items.pop()
            self.tokens -= len(item.ids)
        else:
            self._measure(at)
        return item, start


def pack_examples(examples, limits: Limits, first_sequence: int):
    """Record batches of pieces for an iterator of examples, by one task."""
    pool, source = Pool(limits), iter(examples)
    rows: list[tuple] = []
    held, sequence, more = 0, first_sequence, True
    while True:
        while more and len(pool.items) < limits.pool and pool.tokens < limits.pool_tokens:
            item = next(source, None)
            more = item is not None
            if more and len(item.ids):
                pool.add(item)
        if not pool.items:
            break
        room, offset = pool.capacity.copy(), 0
        while pool.items:
            at, whole = pool.best(room)
            if at < 0:
                break
            item = pool.items[at]
            n = len(item.ids) - item.start if whole else item.cut(int(room[0]), int(room[2]))
            if n == 0:
                break
            item, start = pool.take(at, n)
            loss = n if item.loss is None else int(item.loss[start + n] - item.loss[start])
            piece = item.ids[start : start + n].astype("<u4", copy=False).tobytes()
            rows.append((item.id, start, n, piece, len(item.ids), loss, sequence, offset))
            room -= (n, 1, loss)
            offset, held = offset + n, held + n
        if offset == 0:
            raise ValueError("loss_tokens is 0, but an example is left that begins with an id that bears loss")
        sequence += 1
        if held >= 1 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW
    )


def _first_sequence() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() * PER_TASK


def pack(examples: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Pieces of ``examples (id, ids, loss_mask)`` and the sequences they lie in.

    ``ids`` is a binary of little-endian unsigned 32-bit ids, ``loss_mask`` a binary with one byte
    per id, not 0 where the id bears loss (null: all do). Each task packs the rows it reads, so no
    row moves; only a task's last sequences have much padding. Returns per piece ``id``, ``start``
    (ids of its example before it), ``length``, ``ids``, ``example_tokens``, ``loss_tokens``,
    ``sequence_id`` and ``offset`` (where it lies in its sequence, without gaps).

    Examples without ids or with null ids give no pieces. Longer examples than a sequence has room
    for are cut. Rows that repeat an id are examples of their own. A limit below 1 is an error, but
    ``loss_tokens`` may be 0 if no id bears loss; else such an example can't be placed: an error.
    """
    limits = _checked(limits)

    def run(batches):
        def each():
            for batch in batches:
                for row, ids, mask in zip(*(batch.column(c) for c in ("id", "ids", "loss_mask")), strict=True):
                    if ids.is_valid:
                        loss = np.frombuffer(mask.as_buffer(), np.uint8) if mask.is_valid else None
                        yield Example(row.as_py(), np.frombuffer(ids.as_buffer(), "<u4"), loss)

        yield from pack_examples(each(), limits, _first_sequence())

    return examples.select("id", "ids", "loss_mask").mapInArrow(run, PIECES)


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits | None = None,
) -> DataFrame:
    """``pack`` for whole texts: ids by the tokenizer (its JSON text), then ``end_id``; all bear loss.

    A null text is empty, so its document is ``end_id`` alone. Other columns are not looked at.
    """
    limits = _checked(limits)

    def run(batches):
        yield from pack_examples(_encoded(batches, WordEncoder.of(tokenizer), end_id), limits, _first_sequence())

    return id_and_text(df, id_col, text_col).mapInArrow(run, PIECES)


def _encoded(batches, encoder: WordEncoder, end_id: int):
    for batch in batches:
        for some in text_slices(batch, most_bytes=2 << 20):
            ids, ends = encoder.encode(some.column("text"))
            start = 0
            for row, end in zip(some.column("id").to_pylist(), ends.tolist(), strict=True):
                yield Example(row, np.append(ids[start:end], np.uint32(end_id)), None)
                start = end


def pack_conversations(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    loss_role: str = "assistant",
    limits: Limits | None = None,
) -> DataFrame:
    """``pack`` for ``conversations (conv_id, turn, role, text)``: one example per conversation, its
    turns in order, each ended by ``end_id``; only the turns of ``loss_role`` bear loss.

    Turns are gathered per conversation as texts. Ties in ``turn`` are in order of role and text; a
    null text is empty, a null role bears no loss.
    """
    limits = _checked(limits)
    turn = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = df.groupBy(F.col("conv_id").cast("bigint").alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    flat = gathered.select("id", F.col("turns.text").alias("texts"), F.col("turns.role").alias("roles"))

    def run(batches):
        encoder = WordEncoder.of(tokenizer)

        def each():
            for batch in batches:
                for row, texts, roles in zip(*(batch.column(c) for c in ("id", "texts", "roles")), strict=True):
                    ids, ends = encoder.encode(texts.values)
                    mask = np.repeat([r == loss_role for r in roles.as_py()], np.diff(ends, prepend=0) + 1)
                    yield Example(row.as_py(), np.insert(ids, ends, np.uint32(end_id)), mask)

        yield from pack_examples(each(), limits, _first_sequence())

    return flat.mapInArrow(run, PIECES)


def _checked(limits: Limits | None) -> Limits:
    limits = limits or Limits()
    if min(limits.tokens, limits.segments) < 1 or limits.loss_tokens < 0 or limits.pool < 1:
        raise ValueError(f"a sequence needs room: {limits}")
    return limits
