"""Stacking standardized sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.functions.keys import POSITION, SRC


def _check_types(frames: Sequence[DataFrame]) -> None:
    seen: dict[str, str] = {}
    for number, frame in enumerate(frames, 1):
        for field in frame.schema:
            kind = field.dataType.simpleString()
            if seen.setdefault(field.name, kind) != kind:
                raise ValueError(
                    f"source {number} cannot be combined: column {field.name!r} is {kind}, "
                    f"before it was {seen[field.name]}"
                )


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources, in source order by position; absent columns become null."""
    frames = list(frames)
    if not frames:
        raise ValueError("there is nothing to combine")
    _check_types(frames)
    if all(set(POSITION) <= set(f.columns) for f in frames):
        frames = [f.withColumn(SRC, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
