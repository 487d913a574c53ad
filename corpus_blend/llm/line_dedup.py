"""Repeated runs of lines, found in a suffix array over line ids, and deleted but for the first copy.

The corpus is one sequence of lines in order of document id. Suffixes are ranked by distributed
prefix doubling (Karp, Miller and Rosenberg): the rank of a suffix by its first line is the first
place where that line stands; by ``2 n`` lines it is the first place with the same pair of ranks, its
own by ``n`` lines and that of the suffix ``n`` lines further on. Suffixes of one rank are an interval
of the suffix array in which all neighbours have so many lines in common. A suffix that has
an interval to itself can be no part of a repeated run, so it is dropped on the way.

A run is a repeat if it holds ``min_words`` words or more and has occurred before. Whatever lies in
a repeat lies in one that loses its status if it is shortened at one end: the shortest run of enough
words from its first line, or one that ends further on, shortest towards its start. These shortest
runs are looked up: a run of ``m`` lines lies in the interval of two overlapping ranks by the largest
power of two up to ``m``. So doubling can stop at the longest of them, and yet maximal repeats of any
length are deleted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_blend.llm.common import stage, text_slices

MIN_WORDS = 50
NO_ID = (1 << 63) - 1
DOC = ["doc", "version"]
PLACE = [*DOC, "at"]

_LINES = pa.schema(
    [
        ("doc", pa.int64()),
        ("version", pa.int64()),
        ("at", pa.int64()),
        ("h1", pa.int64()),
        ("h2", pa.int64()),
        ("line", pa.int32()),
        ("ahead", pa.int32()),
        ("ahead_line", pa.int32()),
        ("back", pa.int32()),
        ("back_line", pa.int32()),
    ]
)


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Which document a row is, as ``doc, version``: rows of one id and one text are the same document."""
    return (
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)),
        F.xxhash64(F.col(f"`{text_col}`").cast("string")),
    )


def _free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in whatever case."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def _lines(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """A row per line that is not blank, without the text itself.

    ``at`` counts such lines, ``line`` all lines; ``ahead`` and ``back`` are how many lines the
    shortest run of enough words from here, or up to here, has (0: there is none), the others
    where it ends or begins.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                texts = part.column("text").cast(pa.binary())
                yield pa.RecordBatch.from_arrays(_facts(part, texts, min_words), schema=_LINES)

    doc, version = _keys(id_col, text_col)
    rows = df.select(
        doc.alias("doc"),
        version.alias("version"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    kind = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in _LINES)
    return rows.mapInArrow(run, kind)


def _facts(part: pa.RecordBatch, texts: pa.Array, min_words: int) -> list[pa.Array]:
    columns: list[list[np.ndarray]] = [[] for _ in _LINES]
    for doc, version, text in zip(part.column("doc").to_pylist(), part.column("version").to_pylist(), texts, strict=True):
        known = [(i, x.strip()) for i, x in enumerate(text.as_py().split(b"\n"))]
        known = [(i, x) for i, x in known if x]
        n = len(known)
        line = np.fromiter((i for i, _ in known), np.int64, n)
        digest = b"".join(xxhash.xxh3_128_digest(x) for _, x in known)
        h = np.frombuffer(digest, np.int64).reshape(n, 2)
        sums = np.r_[0, np.cumsum(np.fromiter((len(x.split()) for _, x in known), np.int64, n))]
        at = np.arange(n)
        end = np.searchsorted(sums, sums[:-1] + min_words)  # the run is at .. end - 1
        ahead = np.where(end <= n, end - at, 0)
        begin = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
        back = np.where(begin >= 0, at + 1 - begin, 0)
        found = [
            np.full(n, doc),
            np.full(n, version),
            at,
            h[:, 0],
            h[:, 1],
            line,
            ahead,
            line[np.minimum(end, n) - 1] if n else line,
            back,
            line[np.maximum(begin, 0)] if n else line,
        ]
        for column, values in zip(columns, found, strict=True):
            column.append(values)
    return [
        pa.array(np.concatenate(c) if c else np.zeros(0), f.type, safe=False) for c, f in zip(columns, _LINES, strict=True)
    ]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, version, spans``: the lines to delete, as disjoint ``first, last`` line numbers."""
    lines = stage(_lines(df, id_col, text_col, min_words), "lines")
    place = F.struct(*PLACE)
    seen = F.min(place).alias("rank"), F.count(F.lit(1)).alias("n")
    # Aggregates are written before rows are joined back to them: adaptive execution splits a crowded
    # key only in a join of two plain exchanges.
    by_line = stage(lines.groupBy("h1", "h2").agg(*seen).where("n > 1").drop("n"), "line-ranks")
    facts = ["line", "ahead", "ahead_line", "back", "back_line"]
    active = stage(lines.join(by_line, ["h1", "h2"]).select(*PLACE, "rank", *facts).distinct(), "repeated-lines")
    ahead = active.where("ahead > 0").select(
        *DOC, "at", F.col("ahead").alias("m"), F.col("line").alias("first"), F.col("ahead_line").alias("last")
    )
    back = active.where("back > 0").select(
        *DOC, (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("m"),
        F.col("back_line").alias("first"), F.col("line").alias("last"),
    )
    runs = ahead.unionByName(back).distinct().withColumn("level", F.length(F.bin("m")) - 1)
    longest = active.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    levels = [active.select(*PLACE, "rank")]
    while 2 ** len(levels) <= longest:
        levels.append(stage(_double(levels[-1], 2 ** (len(levels) - 1)), "ranks"))
    ranks = levels[0].withColumn("level", F.lit(0))
    for k, more in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(more.withColumn("level", F.lit(k)))
    # A run of m lines: its rank by the largest power of two, and that of the lines it ends with.
    tail = F.col("at") + F.col("m") - F.expr("shiftleft(1, level)")
    found = runs.join(ranks, [*PLACE, "level"]).withColumnRenamed("rank", "head")
    found = found.withColumns({"begin": F.col("at"), "at": tail}).join(ranks, [*PLACE, "level"]).withColumnRenamed("rank", "tail")
    found = stage(found.withColumn("at", F.col("begin")).select(*PLACE, "m", "head", "tail", "first", "last"), "runs")
    interval = ["m", "head", "tail"]
    earliest = stage(found.groupBy(*interval).agg(*seen).where("n > 1").drop("n"), "intervals")
    later = found.join(earliest, interval).where(F.struct(*PLACE) != F.col("rank"))
    end = (F.col("at") + F.col("m")).alias("end")
    return _spans(later.select(*DOC, "at", end, "first", "last"))


def _spans(runs: DataFrame) -> DataFrame:
    """Runs of each document that overlap or follow each other, but for blank lines, as one span; spans in order."""
    order = Window.partitionBy(*DOC).orderBy("at", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("at") <= reached, 0).otherwise(1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = runs.withColumn("begins", begins).withColumn("span", F.sum("begins").over(so_far))
    merged = numbered.groupBy(*DOC, "span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _double(ranks: DataFrame, n: int) -> DataFrame:
    """Ranks by ``2 n`` lines from those by ``n``; suffixes with a rank of their own are left out."""
    further = ranks.select(*DOC, (F.col("at") - n).alias("at"), F.col("rank").alias("next"))
    pairs = stage(ranks.join(further, PLACE), "rank-pairs")
    first = pairs.groupBy("rank", "next").agg(F.min(F.struct(*PLACE)).alias("new"), F.count(F.lit(1)).alias("n"))
    first = stage(first.where("n > 1").drop("n"), "pair-ranks")
    return pairs.join(first, ["rank", "next"]).select(*PLACE, F.col("new").alias("rank"))


def _without(lines: Column, spans: Column) -> Column:
    """The lines between the spans, cut out as stretches, so that no line is held against each span."""

    def stretch(k):
        begin = F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["last"] + 1)
        end = F.when(k == F.size(spans), F.size(lines)).otherwise(F.get(spans, k)["first"])
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), stretch))


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    removed_col: str | None = None,
) -> DataFrame:
    """``df`` with repeated runs of lines deleted from its texts; all rows and columns stay.

    Lines are compared without white space at their ends; blank lines are no part of the comparison
    but go if the lines before and after them both go. The first copy, by document id and then by place, stays. A
    document that was all repeats is left with an empty text. ``removed_col`` names a column to
    add with the number of deleted lines.

    A null text stays null. Rows of one id and one text are one document, so they are treated
    alike and are no copies of each other. A null id counts as the largest. No rows give no rows.
    """
    spans = stage(repeated_spans(df, id_col, text_col, min_words), "spans")
    own_doc, own_version, own_spans = _free_names(df, "doc", "version", "spans")
    spans = spans.select(F.col("doc").alias(own_doc), F.col("version").alias(own_version), F.col("spans").alias(own_spans))
    doc, version = _keys(id_col, text_col)
    # There may be as many spans as documents, so whatever their number they are not broadcast.
    rows = df.withColumns({own_doc: doc, own_version: version})
    rows = rows.join(spans.hint("merge"), [own_doc, own_version], "left")
    text = F.col(f"`{text_col}`")
    # as the one element of an array, so that the text is split once
    split = F.array(F.split(text, "\n"))
    left = F.get(F.transform(split, lambda x: F.array_join(_without(x, F.col(own_spans)), "\n")), 0)
    removed = F.aggregate(own_spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    edited = {text_col: F.when(F.col(own_spans).isNull(), text).otherwise(left)}
    counts = {removed_col: F.coalesce(removed, F.lit(0).cast("bigint"))} if removed_col else {}
    kept = [c for c in df.columns if c != removed_col]
    return rows.withColumns(edited | counts).select(*[F.col(f"`{c}`") for c in (*kept, *counts)])
