"""Positions as whole numbers of one width, with the table that leads back to them.

A position names its file by a path, which is long and of any length. Sorting, taking the first of
equal rows and interleaving only need an order, so narrow tables carry a number instead: the rows of
all sources' files laid end to end. A file's numbers begin where those of the files before it end, so
the number of a row follows from the table of files, which is small, and no row is exchanged for it.
Where that table would not be small (text keys as positions, or keys spread over more numbers than
there are), rows are ranked instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_blend.functions.keys import FILE, POSITION, ROW, SRC
from corpus_blend.operators.select import dense_index
from corpus_blend.staging import stage

FEW_FILES = 1_000  # the numbers of this many are worked out on the driver
MOST_FILES = 1_000_000
MOST_PATH_BYTES = 64 << 20  # of all files' names together, which are broadcast
MOST_NUMBERS = 1 << 62


@dataclass(frozen=True)
class Places:
    """``table`` has a row per file (``packed``) or per row; ``counts`` are rows by source."""

    table: DataFrame
    packed: bool
    counts: dict[int, int]
    starts: dict[int, int]
    without_gaps: bool

    def pack(self, rows: DataFrame) -> DataFrame:
        """``_no`` (the file's number) and ``_at`` (the row's) in place of ``_file`` and ``_row``."""
        if not self.packed:
            ranked = rows.join(self.table, list(POSITION)).withColumn("_no", F.lit(0).cast("bigint"))
            return ranked.drop(FILE, ROW)
        files = F.broadcast(self.table.select(SRC, FILE, "_no", "_shift"))
        return rows.join(files, [SRC, FILE]).withColumn("_at", F.col(ROW) + F.col("_shift")).drop(FILE, ROW, "_shift")

    def unpack(self, rows: DataFrame) -> DataFrame:
        """``_file`` and ``_row`` beside ``_no`` and ``_at``."""
        if not self.packed:
            return rows.join(self.table.select("_at", FILE, ROW), "_at")
        files = F.broadcast(self.table.select("_no", FILE, "_shift"))
        return rows.join(files, "_no").withColumn(ROW, F.col("_at") - F.col("_shift")).drop("_shift")

    def indexed(self, packed: DataFrame) -> DataFrame:
        """Add ``_index``, a row's number from 0 within its source."""
        if not self.without_gaps:
            return dense_index(packed, "_at", within=SRC)
        start = F.lit(None).cast("bigint")
        for source, first in self.starts.items():
            start = F.when(F.col(SRC) == source, F.lit(first).cast("bigint")).otherwise(start)
        return packed.withColumn("_index", F.col("_at") - start)


def places_of(rows: DataFrame) -> Places:
    """Looks at positions only, and exchanges a row per file and task."""
    spark, keys = rows.sparkSession, rows.select(*POSITION)
    files = keys.groupBy(SRC, FILE).agg(F.min(ROW).alias("_first"), F.max(ROW).alias("_last"), F.count("*").alias("_n"))
    files = stage(files, "files")
    few = files.limit(FEW_FILES + 1).collect()
    if len(few) <= FEW_FILES:
        return _of_few(spark, sorted(tuple(r) for r in few), keys)
    wide = "decimal(38,0)"
    span = F.col("_last").cast(wide) - F.col("_first").cast(wide) + 1
    furthest = F.greatest(F.abs(F.col("_first").cast(wide)), F.abs(F.col("_last").cast(wide)))
    by_source = files.groupBy(SRC).agg(
        F.sum("_n").alias("n"),
        F.sum(span).alias("span"),
        F.max(furthest).alias("furthest"),
        F.count("*").alias("files"),
        F.sum(F.octet_length(FILE)).alias("bytes"),
    )
    found = sorted(by_source.collect(), key=lambda r: r[SRC])  # one row per source
    counts, spans = {r[SRC]: r["n"] for r in found}, {r[SRC]: int(r["span"]) for r in found}
    small = sum(r["files"] for r in found) <= MOST_FILES and sum(r["bytes"] for r in found) <= MOST_PATH_BYTES
    if not small or sum(r["span"] + r["furthest"] for r in found) >= MOST_NUMBERS:
        return _ranked(keys, counts)
    order = Window.orderBy(SRC, FILE)  # MOST_FILES rows at most
    before = F.coalesce(F.sum(span).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = (before - F.col("_first").cast(wide)).cast("bigint")
    number = F.row_number().over(order).cast("bigint")
    table = stage(files.select(SRC, FILE, number.alias("_no"), shift.alias("_shift")), "file-numbers")
    return Places(table, True, counts, _starts(spans), spans == counts)


def _of_few(spark: SparkSession, files: list[tuple], keys: DataFrame) -> Places:
    counts, spans, table, upto = {}, {}, [], 0
    for number, (source, file, first, last, n) in enumerate(files, 1):
        table.append((source, file, number, upto - first))
        upto += last - first + 1
        counts[source] = counts.get(source, 0) + n
        spans[source] = spans.get(source, 0) + last - first + 1
    if upto >= MOST_NUMBERS or any(abs(t[3]) >= MOST_NUMBERS for t in table):
        return _ranked(keys, counts)
    schema = f"{SRC} int, {FILE} string, _no bigint, _shift bigint"
    return Places(spark.createDataFrame(table, schema), True, counts, _starts(spans), spans == counts)


def _ranked(keys: DataFrame, counts: dict[int, int]) -> Places:
    ranks = stage(dense_index(keys).withColumnRenamed("_index", "_at"), "ranks")
    return Places(ranks, False, counts, _starts(counts), True)


def _starts(lengths: dict[int, int]) -> dict[int, int]:
    """The first number of each source, one laid after the other."""
    starts, upto = {}, 0
    for source in sorted(lengths):
        starts[source] = upto
        upto += lengths[source]
    return starts
