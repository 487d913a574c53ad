"""Explicit row order. A DataFrame has none, so every source carries a sortable position."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.keys import FILE, ROW, SRC, as_list
from corpus_blend.staging import stage


def with_position(df: DataFrame, order_by=None, source: int = 0) -> DataFrame:
    """Add ``_src``, ``_file`` and ``_row``, which together order and identify every row.

    ``order_by`` names a unique column (at most one text and one whole number).
    Without it Parquet rows use file path and row number, rows of other files
    the file path, the start of their block and the order within it. The latter
    hold for one reading only: see ``settled``.
    """
    src = F.lit(source).alias(SRC)
    if order_by:
        file, row = _ordering_columns(df, as_list(order_by))
        return df.select("*", src, file.alias(FILE), row.alias(ROW))
    known = _file_facts(df)
    arrival = F.monotonically_increasing_id().alias(ROW)
    if "row_index" in known:
        place = F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)
    elif "file_block_start" in known:
        place = _block("_metadata.file_path", "_metadata.file_block_start"), arrival
    else:
        place = F.lit("").alias(FILE), arrival
    return df.select("*", src, *place)


def settled(df: DataFrame, order_by=None) -> DataFrame:
    """A positioned frame whose positions stay what they are however often it is read.

    Positions from Parquet row numbers are; those from ``order_by`` are if they name each row, which
    is checked. All others follow from how files are split or a plan is cut into tasks, and so from
    settings and the cores of the moment: such a frame is written once, with its positions.
    """
    if order_by:
        return _checked_order(df, as_list(order_by))
    if "row_index" in _file_facts(df):
        return df
    return stage(df, "positions")


def _checked_order(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the order columns are read; each task sums up its own rows first."""
    columns = [F.col(f"`{n}`") for n in names]
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
    seen = df.select(*columns, missing.alias("_null")).groupBy(*columns, "_null")
    wrong = seen.agg(F.count("*").alias("_n")).where("_n > 1 or _null").limit(1).collect()
    if wrong:
        raise ValueError(
            f"order_by ({', '.join(names)}) must name every row, but {wrong[0][:-2]} "
            f"{'is missing a value' if wrong[0]['_null'] else 'occurs more than once'}; "
            "without order_by rows are taken as they are read"
        )
    return df


def _file_facts(df: DataFrame) -> list[str]:
    """What a file scan tells about its rows; nothing if the frame is no file scan."""
    try:
        return df.select("_metadata.*").columns
    except AnalysisException:
        return []


def _block(path: str, start: str):
    return F.concat(F.col(path), F.lit("#"), F.lpad(F.col(start).cast("string"), 20, "0")).alias(FILE)


def _ordering_columns(df: DataFrame, names: list[str]):
    file, row = F.lit(""), F.lit(0).cast("bigint")
    kinds = []
    for name in names:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.StringType):
            kinds.append("text")
            file = F.coalesce(F.col(name), F.lit(""))
        elif isinstance(dtype, T.IntegralType):
            kinds.append("number")
            row = F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))
        else:
            raise ValueError(f"order_by column {name!r} must hold text or whole numbers, not {dtype}")
    if kinds not in (["text"], ["number"], ["text", "number"]):
        raise ValueError("order_by takes a text column, a whole-number column, or both in that order")
    return file, row
