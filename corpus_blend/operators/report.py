"""Quality, composition and layout reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.chat import CHATML, row_is_blank, row_length
from corpus_blend.functions.keys import POSITION, SRC
from corpus_blend.functions.text import to_text
from corpus_blend.operators.detect import TURN_KEYS, UNKNOWN, detect_format
from corpus_blend.operators.select import peek
from corpus_blend.operators.standardize import blank_after
from corpus_blend.staging import stage

# The rates above which a source, or the whole result, is flagged.
SOURCE_EMPTY_RATE = 0.05
MERGED_EMPTY_RATE = 0.02
HISTOGRAM_BINS = 12
PREVIEW_ROWS = 50


def quality_of(df: DataFrame, blank: Column, by=None, threshold: float = SOURCE_EMPTY_RATE):
    """Rows, blank rows and their rate, per group if asked; ``flagged`` above the threshold."""
    groups = [by] if isinstance(by, str) else list(by or [])
    counted = df.groupBy(*groups).agg(
        F.count("*").alias("sample_size"),
        F.count_if(blank).alias("empty_rows"),
    )
    rate = F.when(F.col("sample_size") > 0, F.col("empty_rows") / F.col("sample_size"))
    counted = counted.withColumn("empty_rate", F.coalesce(rate, F.lit(0.0)))
    return counted.withColumn("flagged", F.col("empty_rate") > threshold)


def quality(df: DataFrame, target: str, by=None, threshold: float = SOURCE_EMPTY_RATE) -> DataFrame:
    """Blank rows after standardizing, over all rows."""
    return quality_of(df, row_is_blank(target), by, threshold)


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_dataset").agg(F.count("*").alias("n_rows"))


def role_counts(df: DataFrame) -> DataFrame:
    """Messages per role; Spark adds up each task's messages before the exchange."""
    return (
        df.select(F.explode("messages.role").alias("role"))
        .groupBy("role")
        .agg(F.count("*").alias("n_messages"))
    )


def histogram_of(df: DataFrame, length: Column, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width length bin, closed on the right; empty bins are left out.

    Rows are read once, to count the lengths; bounds and bins are taken from those counts.
    """
    counts = stage(df.groupBy(length.alias("length")).agg(F.count("*").alias("n")), "lengths")
    low = counts.agg(F.min("length")).scalar()
    high = counts.agg(F.max("length")).scalar()
    placed = counts.select("length", "n", low.alias("low"), high.alias("high"))
    span = F.col("high") - F.col("low")
    # whole numbers only: bin = ceil((length - low) * bins / span), at least 1
    up = F.floor(
        ((F.col("length") - F.col("low")) * bins + span - 1) / F.greatest(span, F.lit(1))
    ).cast("int")
    return (
        placed.withColumn("bin", F.greatest(up, F.lit(1)))
        .groupBy("bin")
        .agg(
            F.sum("n").alias("n_rows"),
            F.min("length").alias("shortest"),
            F.max("length").alias("longest"),
        )
    )


def length_histogram(df: DataFrame, target: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    return histogram_of(df, row_length(target), bins)


def merge_statistics(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """Composition of a merged frame: rows per source, messages per role, length bins."""
    tables = {"source_counts": source_counts(df), "lengths": length_histogram(df, target)}
    if target == CHATML:
        tables["role_counts"] = role_counts(df)
    return tables


def source_report(df: DataFrame, target: str, formats: Sequence[str]) -> DataFrame:
    """Per source: its label, the layout it was read as, its rows and how many are blank.

    ``formats`` are in order of the sources as they were concatenated: a table listed twice is two
    sources with one label.
    """
    counted = quality(df, target, [SRC, "source_dataset"])
    layouts = F.array(*(F.lit(f) for f in formats))
    return counted.withColumn("format", F.get(layouts, F.col(SRC))).withColumnRenamed(SRC, "source")


# --- before merging ----------------------------------------------------------------


def _public(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in POSITION if c in df.columns])


def inspect_source(
    df: DataFrame, label: str, fmt: str | None = None, strict_first_row: bool = False, count: bool = True
) -> DataFrame:
    """One row: label, layout, rows (null without ``count``), columns and one sample row as JSON."""
    rows = _public(df)
    found = detect_format(rows if not strict_first_row else df, fmt, strict_first_row)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    packed = F.to_json(row, {"ignoreNullFields": "false"})
    sample = peek(rows.select(packed), 1).collect()
    if count:
        counted = rows.agg(F.count("*").alias("n_rows"))
    else:
        counted = df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("n_rows"))
    return counted.select(
        F.lit(label).alias("source"),
        F.lit(found).alias("format"),
        "n_rows",
        F.array(*(F.lit(c) for c in rows.columns)).alias("columns"),
        F.lit(sample[0][0] if sample else None).cast("string").alias("sample"),
    )


def _absent(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return column.isNull() | (column == "")
    return column.isNull()


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("bigint"))


def _turns(df: DataFrame, fmt: str, columns: dict | None) -> tuple[Column, str, str, T.DataType]:
    column, (speaker, said) = TURN_KEYS[fmt]
    name = (columns or {}).get(f"{column}_key") or column
    element = df.schema[name].dataType.elementType
    dtype = element[said].dataType if isinstance(element, T.StructType) else element.valueType
    turns = F.filter(F.col(f"`{name}`"), lambda t: t.isNotNull())
    return turns, speaker, said, dtype


def profile_source(
    df: DataFrame, label: str, fmt: str | None = None, columns: dict | None = None
) -> DataFrame:
    """One row over the whole source: mean length (of turns, or of rows), missing values, rows
    left empty by standardizing, and text values that look like JSON lists."""
    found = detect_format(df, fmt)
    names = _public(df).columns
    if found in TURN_KEYS:
        turns, _, said, dtype = _turns(df, found, columns)
        sizes = F.transform(turns, lambda t: F.length(to_text(t.getItem(said), dtype)).cast("bigint"))
        length = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, n: a + n)
        pieces = F.size(turns)
    else:
        length = _total(
            [F.length(to_text(F.col(f"`{c}`"), df.schema[c].dataType)) for c in names]
        )
        pieces = F.lit(1)
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    empty = F.lit(False) if found == UNKNOWN else blank_after(df, found, columns)
    zero = F.lit(0).cast("bigint")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(
            F.sum(length) / F.nullif(F.sum(pieces), F.lit(0)), F.lit(0.0)
        ).alias("avg_length"),
        _total([F.count_if(_absent(df, c)) for c in names]).alias("n_missing"),
        F.coalesce(F.count_if(empty), zero).alias("n_empty"),
        _total([F.count_if(F.col(f"`{c}`").startswith("[{")) for c in texts]).alias("n_json_like"),
    ).select(F.lit(label).alias("source"), F.lit(found).alias("format"), "*")


def profile_roles(
    df: DataFrame, label: str, fmt: str | None = None, columns: dict | None = None
) -> DataFrame:
    """The roles a chat source uses, as spelled there, with the number of turns of each."""
    found = detect_format(df, fmt)
    if found not in TURN_KEYS:
        raise ValueError(f"{label!r} was read as {found!r}, which has no roles")
    turns, speaker, _, _ = _turns(df, found, columns)
    role = F.coalesce(F.col("t").getItem(speaker).cast("string"), F.lit("?"))
    return (
        df.select(F.explode(turns).alias("t"))
        .groupBy(role.alias("role"))
        .agg(F.count("*").alias("n_turns"))
        .select(F.lit(label).alias("source"), "role", "n_turns")
    )
