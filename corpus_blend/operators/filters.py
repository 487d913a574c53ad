"""Row-wise steps after combining: system prompt and length bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.functions.chat import MESSAGES_TYPE, as_messages, message, row_length


def inject_system_prompt(df: DataFrame, prompt: str | None) -> DataFrame:
    """Put a system message in front of every row that does not begin with one."""
    if not prompt:
        return df
    messages = as_messages(F.col("messages"))
    opening = F.get(messages, F.lit(0)).getField("role")
    extended = F.concat(
        F.array(message("system", F.lit(prompt))).cast(MESSAGES_TYPE), messages
    )
    return df.withColumn(
        "messages", F.when(opening.eqNullSafe(F.lit("system")), messages).otherwise(extended)
    )


def length_bounds(length, min_len: int | None, max_len: int | None):
    kept = F.lit(True)
    if min_len is not None:
        kept = kept & (length >= min_len)
    if max_len is not None:
        kept = kept & (length <= max_len)
    return kept


def filter_length(df: DataFrame, target: str, min_len: int | None, max_len: int | None) -> DataFrame:
    """Rows whose length lies within the bounds, ends included; a missing bound is no bound."""
    if min_len is None and max_len is None:
        return df
    return df.where(length_bounds(row_length(target), min_len, max_len))
