"""Token ids in Simple-8b words: a binary file format, its writer and its reader.

A file holds the ids of whole documents in order. All numbers are little-endian:

    header   magic "S8BT", version, block size, numbers of documents, of those without an id (the
             file's last ones), of ids, blocks and words
    tables   document ids, ids of each document, first word of each block (int64 each)
    words    64 bits each: 4 bits of selector, 60 bits of ids

A selector says how many ids a word holds and how many bits each has. Selector 0 is an escape: the
next word is one id of more than 60 bits. Blocks hold the same number of ids (the last one the
rest) and begin at words of their own, so that any block can be decoded without the others, and
all of them at once.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_blend.llm.common import id_and_text, new_folder, open_input, stage, text_slices, write_file
from corpus_blend.llm.word_ids import WordEncoder

MAGIC, VERSION = b"S8BT", 2
HEADER = struct.Struct("<4sIQQQQQQ")
BLOCK = 1024
FILE_IDS = 4 << 20
# Fixed values of the code: how many ids a word of each selector holds, and of how many bits.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of unsigned ``values``, and where each block begins in them.

    Every word takes the most values that fit into it and lie in its block.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    begin = np.arange(0, n, block)
    end = np.minimum(begin + block, n)
    left = (np.repeat(end, end - begin) - np.arange(n)).astype(np.int32)
    best = np.zeros(n, np.int8)
    widest, span = bit_lengths(values), 1  # the widest of the next ``span`` values
    for selector in range(15, 0, -1):
        count = int(COUNTS[selector])
        if count > n:
            break
        if count > span:
            further = widest.copy()
            np.maximum(widest[: n - count + span], widest[count - span :], out=further[: n - count + span])
            widest, span = further, count
        best[(widest <= WIDTHS[selector]) & (left >= count)] = selector
    starts = _chain(begin, end, COUNTS[best])
    kinds = best[starts]
    size = 1 + (kinds == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = kinds.astype(np.uint64)
    for selector in range(2, 16):
        at, to = starts[kinds == selector], place[kinds == selector]
        for i in range(COUNTS[selector] if len(at) else 0):
            words[to] |= values[at + i] << np.uint64(4 + i * WIDTHS[selector])
    words[place[kinds == 0] + 1] = values[starts[kinds == 0]]
    return words, place[np.searchsorted(starts, begin)]


def bit_lengths(values: np.ndarray) -> np.ndarray:
    found = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1) << np.uint64(step)
        found[high] += step
        rest[high] >>= np.uint64(step)
    return found + (rest > 0).astype(np.uint8)


def _chain(begin: np.ndarray, end: np.ndarray, takes: np.ndarray) -> np.ndarray:
    """Where words begin: from the start of every block on, all blocks in step."""
    found, at, rows = [], begin.copy(), np.arange(len(begin))
    owners = []
    while len(at):
        found.append(at)
        owners.append(rows)
        at = at + takes[at]
        on = at < end[rows]
        at, rows = at[on], rows[on]
    if not found:
        return np.zeros(0, np.int64)
    starts, owners = np.concatenate(found), np.concatenate(owners)
    return starts[np.argsort(owners, kind="stable")]


def decode(words: np.ndarray) -> np.ndarray:
    """The values of ``words``, which begin with a whole block."""
    kinds = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(kinds == 0).tolist():  # escapes; what follows one is no selector
        if not raw[at]:
            raw[at + 1] = True
    size = np.where(raw, 0, COUNTS[kinds])
    place = np.cumsum(size) - size
    values = np.zeros(int(size.sum()), np.uint64)
    for selector in range(2, 16):
        own = np.flatnonzero((kinds == selector) & ~raw)
        width = np.uint64(WIDTHS[selector])
        mask = (np.uint64(1) << width) - np.uint64(1)
        for i in range(COUNTS[selector] if len(own) else 0):
            values[place[own] + i] = words[own] >> np.uint64(4 + i * int(width)) & mask
    after = np.flatnonzero(raw)
    values[place[after - 1]] = words[after]
    return values


def pack_file(out, doc_ids: list[int], counts: list[int], parts: list[tuple[np.ndarray, np.ndarray]], block: int):
    """Write one file; ``parts`` are encoded runs of whole blocks."""
    words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.uint64)
    shift = np.cumsum([0, *(len(w) for w, _ in parts)])
    blocks = np.concatenate([b + s for (_, b), s in zip(parts, shift, strict=False)]) if parts else np.zeros(0, int)
    unnamed = sum(i is None for i in doc_ids)
    out.write(HEADER.pack(MAGIC, VERSION, block, len(doc_ids), unnamed, sum(counts), len(blocks), len(words)))
    for table in ([i or 0 for i in doc_ids], counts, blocks):
        out.write(np.asarray(table, "<i8").tobytes())
    out.write(words.astype("<u8", copy=False).tobytes())


class TokenFile:
    """Reads a file, whole or some blocks of it."""

    def __init__(self, source):
        self.source = source
        found = HEADER.unpack(source.read(HEADER.size))
        if found[:2] != (MAGIC, VERSION):
            raise ValueError("not a file of this format")
        self.block, docs, unnamed, self.n_ids, blocks, self.n_words = found[2:]
        self.named = docs - unnamed
        self.doc_ids, self.counts, self.blocks = (self._numbers(k, "<i8") for k in (docs, docs, blocks))
        self.words_at = HEADER.size + 8 * (2 * docs + blocks)

    def _numbers(self, n: int, kind: str) -> np.ndarray:
        data = self.source.read(8 * n)
        if len(data) != 8 * n:
            raise ValueError("the file breaks off")
        return np.frombuffer(data, kind)

    def ids(self, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
        """The ids of blocks ``first_block`` up to before ``last_block``."""
        edges = np.r_[self.blocks, self.n_words]
        begin, end = edges[first_block], edges[len(self.blocks) if last_block is None else last_block]
        self.source.seek(int(self.words_at + 8 * begin))
        return decode(self._numbers(int(end - begin), "<u8"))


def write_tokens(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids under ``folder`` in ascending
    order of ``id_col``, nulls last; returns a row per file: ``path, documents, ids``. Files sort by name in
    the order of their documents and hold ``file_ids`` ids and what comes with the last slice of texts.

    ``tokenizer`` is the JSON text of a tokenizer. A null text is empty, and so is its encoding: its
    document holds ``end_id`` alone. Rows that repeat an id, and those without one, follow each other
    in order of a hash of their texts, then of the texts, so that they need not be one task's. No rows
    give no files.
    """
    folder = folder or new_folder(df.sparkSession, "tokens")
    rows = id_and_text(df, id_col, text_col)
    order = F.col("id").asc_nulls_last(), F.xxhash64("text")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, number = WordEncoder.of(tokenizer), 0
        waiting = _Waiting(block)
        part = TaskContext.get().partitionId()

        def flush():
            path = f"{folder}/part-{part:06d}-{number:06d}.s8b"
            with write_file(path) as out:
                pack_file(out, *waiting.close(), block)
            return pa.RecordBatch.from_pydict({"path": [path], "documents": [waiting.documents], "ids": [waiting.ids]})

        for batch in batches:
            for some in text_slices(batch):
                ids, ends = encoder.encode(some.column("text"))
                counts = np.diff(ends, prepend=0)
                waiting.add(some.column("id").to_pylist(), counts + 1, np.insert(ids, ends, np.uint32(end_id)))
                if waiting.ids >= file_ids:
                    yield flush()
                    waiting, number = _Waiting(block), number + 1
        if waiting.documents:
            yield flush()

    return stage(ordered.mapInArrow(run, "path string, documents bigint, ids bigint"), "token-files")


class _Waiting:
    """Documents of the file being written; their ids are encoded as soon as a block is full."""

    def __init__(self, block: int):
        self.block, self.doc_ids, self.counts, self.parts = block, [], [], []
        self.rest, self.documents, self.ids = np.zeros(0, np.uint32), 0, 0

    def add(self, doc_ids: list[int], counts: np.ndarray, ids: np.ndarray):
        self.doc_ids += doc_ids
        self.counts += counts.tolist()
        self.documents, self.ids = self.documents + len(doc_ids), self.ids + len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // self.block * self.block
        for at in range(0, whole, 512 * self.block):
            self.parts.append(encode(ids[at : min(whole, at + 512 * self.block)], self.block))
        self.rest = ids[whole:]

    def close(self):
        if len(self.rest):
            self.parts.append(encode(self.rest, self.block))
        return self.doc_ids, self.counts, self.parts


def read_tokens(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """``file, id, start, n_tokens, ids`` of every document in ``folder``'s files: ``ids`` are
    little-endian unsigned 32-bit integers, ``start`` counts the ids before it in its file, or with
    ``files``, which ``write_tokens`` returned, in all files in order of their names."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path")
    if files is None:
        found = found.withColumn("before", F.lit(0).cast("bigint"))
    else:
        # Known per file before any is opened, so that no row of a document has to be joined.
        found = found.withColumn("file_name", _name("path")).join(file_offsets(files), "file_name").drop("file_name")
    kind = "file string, id bigint, start bigint, n_tokens bigint, ids binary"
    return found.repartition(max(1, min(found.count(), 20_000)), "path").mapInArrow(_read_files, kind)


def _read_files(batches):
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            with open_input(path) as source:
                yield from _documents(path, TokenFile(source), before)


def _documents(path: str, file: TokenFile, before: int, most: int = 1 << 20):
    """Rows of some documents at a time, of about ``most`` ids or one document."""
    ends = np.cumsum(file.counts)
    first = 0
    while first < len(ends):
        start = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + most, side="right")))
        stop = int(ends[last - 1])
        at = start // file.block
        ids = file.ids(at, -(-stop // file.block)).astype("<u4")[start - at * file.block :][: stop - start]
        edges = np.r_[start, ends[first:last]]
        offsets = ((edges - start) * 4).astype(np.int32)
        n = last - first
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([path] * n),
                pa.array(file.doc_ids[first:last], mask=np.arange(first, last) >= file.named),
                pa.array(edges[:-1] + before),
                pa.array(file.counts[first:last]),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]),
            ],
            names=["file", "id", "start", "n_tokens", "ids"],
        )
        first = last


def _name(path: str):
    return F.element_at(F.split(path, "/"), -1)


def file_offsets(files: DataFrame) -> DataFrame:
    """``file_name, before``: the ids in all files before each; one narrow row per file."""
    before = F.sum("ids").over(Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1))
    named = files.select(_name("path").alias("file_name"), "ids")
    return named.select("file_name", F.coalesce(before, F.lit(0)).alias("before"))
