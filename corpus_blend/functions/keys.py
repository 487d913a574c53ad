"""Row positions and the hash keys that stand in for random numbers.

A hash of (seed, row key) gives the same order on any cluster and survives the
recomputation of a lost task, which ``rand(seed)`` does not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SRC, FILE, ROW = "_src", "_file", "_row"
POSITION = (SRC, FILE, ROW)

HASH_BITS = 52


def as_list(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def key_text(key) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in as_list(key)])


def hash_number(salt, text: Column) -> Column:
    """A whole number below 2^52 drawn from (salt, text)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), text))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def not_after(columns, values) -> Column:
    """Row order comparison ``columns <= values``, written so that scans can use it."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    conditions = []
    for i, (column, value) in enumerate(zip(columns, values)):
        same = [c == F.lit(v) for c, v in zip(columns[:i], values[:i])]
        last = i == len(values) - 1
        here = column <= F.lit(value) if last else column < F.lit(value)
        conditions.append(reduce(lambda a, b: a & b, [*same, here]))
    return reduce(lambda a, b: a | b, conditions)
