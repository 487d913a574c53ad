"""Removing repeated rows; the first in position order stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_blend.functions.chat import row_hash, row_preview
from corpus_blend.functions.keys import POSITION, as_list

EXAMPLES = 3


def _ranked(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(digest).orderBy(*order))
    return df.withColumn("_rank", rank)


def first_dropped(keys: DataFrame, digest: str, order=POSITION, limit: int = EXAMPLES) -> DataFrame:
    """The first ``limit`` of the rows that are not the first of their digest.

    None of them ranks beyond ``limit + 1`` in its set, so later ranks need not be kept.
    """
    order = as_list(order)
    near = _ranked(keys, digest, order).where(f"_rank <= {limit + 1}")
    return near.where("_rank > 1").drop("_rank").orderBy(*order).limit(limit)


def dedupe(
    df: DataFrame, target: str, normalize: bool = False, strict: bool = False, order=POSITION
) -> DataFrame:
    """First row of every set of equal rows.

    Spark turns the rank filter into a group limit on both sides of the
    exchange, so a task sends at most one row per set however often it occurs.
    """
    digest = F.unhex(row_hash(target, normalize, strict))
    ranked = _ranked(df.withColumn("_digest", digest), "_digest", as_list(order))
    return ranked.where("_rank = 1").drop("_rank", "_digest")


def duplicates(
    df: DataFrame,
    target: str,
    normalize: bool = False,
    strict: bool = False,
    limit: int = EXAMPLES,
    order=POSITION,
) -> DataFrame:
    """The first ``limit`` rows that ``dedupe`` drops: position, source and opening text.

    Only hashes and positions are exchanged.
    """
    order = as_list(order)
    digest = F.unhex(row_hash(target, normalize, strict)).alias("_digest")
    first = first_dropped(df.select(*order, digest), "_digest", order, limit).select(*order)
    shown = df.select(*order, "source_dataset", row_preview(target).alias("preview"))
    # at most ``limit`` rows, whatever the size of the data
    return shown.join(F.broadcast(first), order, "left_semi")
