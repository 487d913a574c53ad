"""Ranked lexical search by hashed max-sketches.

A document's sketch has a few times as many cells as the document has distinct terms. Two hashes put
each term into two cells, and a cell keeps the largest count of all terms that fall into it. What a
term adds to a score grows with its count, so the smaller of a term's two cells gives no less than the
term's true share, and nothing for most terms that the document lacks: looked up for all terms of many
queries at once, sketches give upper bounds of scores. Per query, documents are then scored exactly in
falling order of their bounds, until the bounds fall below the score that is needed to be ranked.

Scores are whole numbers (see ``impacts`` and ``weights``), so they are the same on any cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_blend.llm.common import id_and_text, stage, text_slices

#: Cells per distinct term at least (the number of cells is a power of two), and the fewest cells.
CELLS_PER_TERM = 8
FEWEST_CELLS = 64
#: The largest count that a cell can tell; it stands for this many and more.
MOST_TOLD = 255
#: Queries are answered some at a time: so many, or such with so many terms together.
QUERIES_AT_ONCE = 256
TERMS_AT_ONCE = 16_384
#: Numbers (documents x terms or queries) that a task holds per matrix.
MOST_NUMBERS = 4 << 20
#: What impacts stay below.
LIMIT = 1_000_000

INDEX = "id bigint, n bigint, sketch binary, terms string, counts binary"


def _cleaner() -> np.ndarray:
    """What each byte becomes: digits, letters and all bytes from 0x80 on stay (A-Z as a-z), the rest
    are spaces."""
    table = np.full(256, 0x20, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


CLEAN = _cleaner()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in a row, as they stand, and the number of the text each is from."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    body = CLEAN[body]
    keep = body != 0x20
    begins = keep.copy()
    edges = (offsets - offsets[0])[:-1]
    edges = edges[edges < len(body)]
    after = np.zeros(len(body), bool)
    after[1:] = keep[:-1]
    after[edges] = False  # a text's first byte continues no term of the text before
    begins &= ~after
    first = np.flatnonzero(begins)
    place = np.cumsum(keep) - 1  # of each byte among those that stay
    bounds = np.r_[place[first], keep.sum()].astype(np.int64)
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(body[keep])]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), buffers)
    return terms, np.searchsorted(offsets - offsets[0], first, side="right") - 1


def hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def cells(found: np.ndarray, width) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash in sketches of ``width`` cells, a power of two."""
    low = found & np.uint64(0xFFFFFFFF)
    last = np.asarray(width, np.uint64) - np.uint64(1)
    return (low & last).astype(np.int64), ((found >> np.uint64(32)) & last).astype(np.int64)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``df``, written: ``id``, ``n`` terms with repeats, the sketch, the distinct terms
    (joined by spaces) and their counts (little-endian unsigned 32-bit).

    A null or empty text has no terms. Texts of any length are taken whole; repeated rows are
    documents of their own; no rows give an empty index; other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, most_bytes=4 << 20):
                yield _indexed(part)

    return stage(id_and_text(df, id_col, text_col).mapInArrow(run, INDEX), "index")


def _indexed(part: pa.RecordBatch) -> pa.RecordBatch:
    rows = part.num_rows
    terms, row = terms_of(part.column("text"))
    coded = terms.dictionary_encode()
    values = len(coded.dictionary)
    pairs, counts = np.unique(row * max(values, 1) + np.asarray(coded.indices, np.int64), return_counts=True)
    row, code = pairs // max(values, 1), pairs % max(values, 1)
    distinct = np.bincount(row, minlength=rows)
    n = np.bincount(row, weights=counts, minlength=rows).astype(np.int64)
    width = np.maximum(FEWEST_CELLS, 1 << np.ceil(np.log2(np.maximum(distinct * CELLS_PER_TERM, 1))).astype(np.int64))
    ends = np.cumsum(width)
    sketch = np.zeros(int(ends[-1]) if rows else 0, np.uint8)
    told = np.minimum(counts, MOST_TOLD).astype(np.uint8)
    for cell in cells(hashes(coded.dictionary.to_pylist())[code], width[row]):
        np.maximum.at(sketch, ends[row] - width[row] + cell, told)
    spaced = pc.binary_join_element_wise(coded.dictionary, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    upto = np.r_[0, np.cumsum(distinct)]
    listed = spaced.take(pa.array(code))
    bytes_upto = np.r_[0, np.cumsum(np.asarray(pc.binary_length(listed), np.int64))][upto]
    joined = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), rows, [None, pa.py_buffer(bytes_upto), pa.py_buffer(b"".join(listed.to_pylist()))]
    )
    return pa.RecordBatch.from_arrays(
        [
            part.column("id"),
            pa.array(n),
            _binary(sketch, np.r_[0, ends]),
            joined.cast(pa.binary()).cast(pa.string()),
            _binary(counts.astype("<u4"), upto * 4),
        ],
        names=["id", "n", "sketch", "terms", "counts"],
    )


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).cast(pa.binary())


# --- queries ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """Queries that are answered together: their ids, and (query, term) pairs by number."""

    ids: list
    terms: list[bytes]
    query: np.ndarray
    term: np.ndarray


def blocks_of(items: DataFrame, id_col: str, text_col: str):
    """The queries in blocks of bounded size; only one block is with the driver at a time."""
    n_bytes = F.sum(F.octet_length("text"))
    rows = id_and_text(items, id_col, text_col)
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(n_bytes, F.lit(0))).first()
    parts = max(1, math.ceil(n / QUERIES_AT_ONCE), math.ceil(size / 6 / TERMS_AT_ONCE))

    def run(batches):
        block, queries, held = 0, 0, 0
        for batch in batches:
            terms, row = terms_of(batch.column("text"))
            values = terms.to_pylist()
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, number in enumerate(batch.column("id").to_pylist()):
                own = sorted(set(values[edges[i] : edges[i + 1]]))
                if queries and (queries == QUERIES_AT_ONCE or held + len(own) > TERMS_AT_ONCE):
                    block, queries, held = block + 1, 0, 0
                queries, held = queries + 1, held + len(own)
                line = pa.array([b" ".join(own)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([number], pa.int64()), line], names=["block", "id", "terms"])

    if parts > 1:
        rows = rows.repartition(parts)
    else:
        rows = rows.coalesce(1)  # what one block may hold
    cut = rows.mapInArrow(run, "block bigint, id bigint, terms string").withColumn("part", F.spark_partition_id())
    cut = stage(cut, "queries")
    for part, block in sorted(tuple(r) for r in cut.select("part", "block").distinct().collect()):
        own = cut.where((F.col("part") == part) & (F.col("block") == block)).select("id", "terms").collect()
        numbers: dict[bytes, int] = {}
        query, term = [], []
        for i, r in enumerate(own):
            for t in r.terms.encode().split():
                query.append(i)
                term.append(numbers.setdefault(t, len(numbers)))
        yield Block([r.id for r in own], list(numbers), np.array(query, np.int64), np.array(term, np.int64))


def weights(n_docs: int, df: list[int]) -> np.ndarray:
    """A term's weight by the documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)


def norms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """A document's length against the mean, in hundredths, of which a tenth always counts."""
    if total == 0:
        return np.full(len(n), 10, np.int64)
    if 90 * n_docs * int(n.max(initial=0)) < 1 << 63:
        return 10 + 90 * n * n_docs // total
    return np.array([10 + 90 * x * n_docs // total for x in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs ``tf`` times adds to a score, before its weight; grows with ``tf``."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _held_by(index: DataFrame, block: Block) -> list[int]:
    """How many documents hold each of the block's terms."""
    shared = index.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches):
        known = pa.array(shared.value, pa.large_binary())
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in text_slices(batch, "terms", 4 << 20):
                terms, _ = terms_of(part.column("terms"))  # distinct ones of each document
                place = pc.index_in(terms, value_set=known).drop_null()
                total += np.bincount(np.asarray(place), minlength=len(known))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    # as many rows as the block has terms
    found = dict(index.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    return [found.get(i, 0) for i in range(len(block.terms))]


# --- searching --------------------------------------------------------------------------


def search(
    index: DataFrame, items: DataFrame, top: int = 10, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's ``top`` documents with a score above 0.

    A query's terms count once each. Equal scores rank by ascending id, a null id last. Queries that
    repeat an id are queries of their own; one without terms, or no query at all, has no rows; neither
    has any query on an empty index.
    """
    spark = index.sparkSession
    n_docs, total = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = []
    for block in blocks_of(items, id_col, text_col):
        if n_docs and block.terms:
            found.append(stage(_answer(index, block, n_docs, total, top), "ranked"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)


def _answer(index: DataFrame, block: Block, n_docs: int, total: int, top: int) -> DataFrame:
    weight = weights(n_docs, _held_by(index, block))
    shared = index.sparkSession.sparkContext.broadcast((block, weight))

    def run(batches):
        searcher = Searcher(*shared.value, n_docs, total, top)
        for batch in batches:
            for part in text_slices(batch, "sketch", 8 << 20):
                for at in range(0, part.num_rows, searcher.rows_at_once):
                    searcher.see(part.slice(at, searcher.rows_at_once))
        yield from searcher.ranked()

    schema = "query int, item_id bigint, doc_id bigint, score bigint"
    best = index.where("n > 0").mapInArrow(run, schema)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


class Searcher:
    """A task's best documents for each query of a block."""

    def __init__(self, block: Block, weight: np.ndarray, n_docs: int, total: int, top: int):
        self.block, self.n_docs, self.total, self.top = block, n_docs, total, top
        self.hashes = hashes(block.terms)
        self.known = pa.array(block.terms, pa.large_binary())
        n = len(block.ids)
        # Sums of products stay far below 2^53, so double precision holds them exactly.
        self.weights = np.zeros((len(block.terms), n))
        self.weights[block.term, block.query] = weight[block.term]
        edges = np.searchsorted(block.query, np.arange(n + 1))
        self.own = [block.term[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.rows_at_once = max(1, MOST_NUMBERS // max(len(block.terms), n))
        nothing = np.zeros(0, np.int64)
        self.best = [(nothing, nothing, np.zeros(0, bool)) for _ in range(n)]  # scores, ids, whether there is an id
        self.needed = np.ones(n)  # the least score that can still be ranked
        self.n_scored = 0

    def see(self, part: pa.RecordBatch) -> None:
        m = norms(np.asarray(part.column("n"), np.int64), self.n_docs, self.total)
        bounds = self.bounds(part, m)
        open_ = (bounds >= self.needed).any(axis=1)
        if not open_.any():
            return
        part, m, bounds = part.filter(pa.array(open_)), m[open_], bounds[open_]
        exact = self.exact(part, m)
        has_id = np.asarray(part.column("id").is_valid())
        ids = np.asarray(part.column("id").fill_null(0), np.int64)
        for q in np.flatnonzero((bounds >= self.needed).any(axis=0)).tolist():
            self._rank(q, bounds[:, q], exact, ids, has_id)

    def _rank(self, q: int, bound: np.ndarray, exact: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> None:
        """Score documents by falling bounds until the next one's bound is too low."""
        rows = np.flatnonzero(bound >= self.needed[q])
        rows = rows[np.lexsort((ids[rows], ~has_id[rows], -bound[rows]))]
        own = self.own[q]
        weight = self.weights[own, q]
        at, step = 0, 2 * self.top
        while at < len(rows) and bound[rows[at]] >= self.needed[q]:
            now = rows[at : at + step]
            scores = (exact[now[:, None], own] @ weight).astype(np.int64)
            self.n_scored += len(now)
            self._keep(q, scores, ids[now], has_id[now])
            at, step = at + step, 2 * step

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> None:
        new = scores >= self.needed[q]
        scores, ids, has_id = (np.r_[a, b[new]] for a, b in zip(self.best[q], (scores, ids, has_id), strict=True))
        order = np.lexsort((ids, ~has_id, -scores))[: self.top]
        self.best[q] = scores[order], ids[order], has_id[order]
        if len(order) == self.top:
            self.needed[q] = max(1, scores[order[-1]])

    def bounds(self, part: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        """No less than each document's score for each query, by its sketch."""
        sketch = part.column("sketch")
        width = np.asarray(pc.binary_length(sketch), np.int64)
        found = np.zeros((part.num_rows, len(self.block.ids)))
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            table = np.frombuffer(b"".join(sketch.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), w)
            one, two = cells(self.hashes, w)
            told = np.minimum(table[:, one], table[:, two])
            shares = np.zeros(told.shape)
            row, term = np.nonzero(told)
            tf = told[row, term]
            shares[row, term] = np.where(tf == MOST_TOLD, LIMIT, impacts(tf, m[rows][row]))
            found[rows] = shares @ self.weights
        return found

    def exact(self, part: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        """The true impact of each term of the block in each document."""
        terms, row = terms_of(part.column("terms"))
        counts = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<u4")
        place = pc.index_in(terms, value_set=self.known)
        known = np.asarray(place.is_valid())
        place, row = np.asarray(place.fill_null(0), np.int64)[known], row[known]
        found = np.zeros((part.num_rows, len(self.block.terms)))
        found[row, place] = impacts(counts[known], m[row])
        return found

    def ranked(self):
        for q, (scores, ids, has_id) in enumerate(self.best):
            if len(scores):
                number = pa.array([self.block.ids[q]] * len(scores), pa.int64())
                columns = [pa.array([q] * len(scores), pa.int32()), number, pa.array(ids, mask=~has_id), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "item_id", "doc_id", "score"])
