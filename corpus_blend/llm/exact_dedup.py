"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then of all.

Only column expressions. The text is read once (or once more for the surviving rows, see
``digest``); every grouping runs on a narrow table in the shared folder, and each step groups only
the rows that the step before could not tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import BLANK, id_and_text, stage

PREFIX_CHARS = 256


def normalized(text: Column) -> Column:
    """Every run of blanks as one space."""
    return F.regexp_replace(text, BLANK + "+", " ")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest: bool = False,
) -> DataFrame:
    """One row per row of ``df``: ``id``, ``keep_id``, ``group_size``, ``kept`` (and ``sha256``).

    Texts are equal if they are after every run of blanks is one space; a null text is empty. The
    smallest id of a group stays. Without ``digest`` whole contents are hashed only for rows whose
    length and prefix hash occur more than once; with it the digest of every row is part of the
    result, so it is taken in the first pass and the full text is not read again.

    Defined results: no rows give no rows; rows of one id and one text count each in
    ``group_size`` and are all kept or all dropped; a null id is larger than any other and stays
    only if its whole group has none. Other columns of ``df`` are not looked at.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("text", normalized(F.col("text")))
    sha = F.sha2("text", 256)
    facts = stage(
        rows.select(
            "id",
            F.octet_length("text").alias("size"),
            F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"),
            *([sha.alias("sha256")] if digest else []),
        ),
        "exact-facts",
    )
    lengths = _repeated(facts, "size")
    same_length = facts.join(lengths, "size", "left_semi")
    prefixes = _repeated(same_length, "size", "prefix")
    if digest:
        suspects = same_length.join(prefixes, ["size", "prefix"], "left_semi").select("id", "sha256")
    else:
        known = [F.octet_length("text").alias("size"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix")]
        survivors = rows.select("id", "text", *known).join(prefixes, ["size", "prefix"], "left_semi")
        suspects = stage(survivors.select("id", sha.alias("sha256")), "exact-digests")
        others = facts.join(prefixes, ["size", "prefix"], "left_anti")
        facts = suspects.unionByName(others.select("id", F.lit(None).cast("string").alias("sha256")))
    groups = (
        suspects.groupBy("sha256")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    groups = stage(groups, "exact-groups")
    keep = F.coalesce("first", "id")
    return facts.join(groups, "sha256", "left").select(
        "id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        *(["sha256"] if digest else []),
    )


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The key values that more than one row has, summed up in each task before they are sent."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    # Written, so that the rows that are joined to it meet it in a plain join of two exchanges: only
    # there adaptive execution can split a key that very many rows have.
    return stage(counted, "exact-repeated")
