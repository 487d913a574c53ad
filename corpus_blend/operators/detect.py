"""Recognising a source's layout from its schema, with a short probe for turn lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.keys import POSITION

# Layout names, the column sets that identify them in order of
# precedence, the turn-list keys, and the synonyms of the fuzzy rule.
UNKNOWN = "unknown"
FUZZY = "alpaca_fuzzy"
TURN_KEYS = {
    "sharegpt": ("conversations", ("from", "value")),
    "chatml": ("messages", ("role", "content")),
}
LAYOUTS = (
    ("preference", ({"chosen", "rejected"},)),
    ("alpaca", ({"instruction", "output"},)),
    ("sharegpt", "turns"),
    ("chatml", "turns"),
    ("prompt_completion", ({"prompt", "completion"}, {"prompt", "response"})),
    ("qa", ({"question", "answer"},)),
    ("input_output", ({"input", "output"},)),
    ("text", ({"text"}, {"content"})),
)
FORMATS = tuple(name for name, _ in LAYOUTS) + (FUZZY,)
SYNONYMS = {
    "instruction": (
        "instruction",
        "prompt",
        "question",
        "query",
        "task",
        "task_description",
        "instr",
    ),
    "input": ("input", "context", "source", "passage"),
    "output": (
        "output",
        "response",
        "answer",
        "completion",
        "target",
        "reply",
        "model_answer",
    ),
}
NEEDED_ROLES = ("instruction", "output")


def fuzzy_mapping(columns: Iterable[str]) -> dict[str, str] | None:
    """Roles found by synonym, each taking the first column whose name contains one."""
    columns = list(columns)
    mapping = {}
    for role, words in SYNONYMS.items():
        matches = (c for c in columns if any(word in c.lower() for word in words))
        column = next(matches, None)
        if column is not None:
            mapping[role] = column
    return mapping if all(role in mapping for role in NEEDED_ROLES) else None


def validate_format(fmt: str | None) -> str | None:
    """``None`` and ``auto`` both mean detection."""
    if fmt in (None, "", "auto"):
        return None
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r} (use one of {', '.join(FORMATS)}, or auto)")
    return fmt


def detect_format(df: DataFrame, override: str | None = None, strict_first_row: bool = False) -> str:
    """Name of the layout; names compare without case, the first layout that fits wins.

    A list of structs is a turn list if its type has the two keys, whatever its rows hold; of maps,
    if the first turn of any row of the source has them. ``strict_first_row`` asks the first
    row by position for a turn with both instead.
    """
    chosen = validate_format(override)
    if chosen:
        return chosen
    names = {c.lower() for c in df.columns}
    for layout, needed in LAYOUTS:
        if needed == "turns":
            column, keys = TURN_KEYS[layout]
            if column in df.columns and _has_turns(df, column, keys, strict_first_row):
                return layout
        elif any(group <= names for group in needed):
            return layout
    public = [c for c in df.columns if c not in POSITION]
    return FUZZY if fuzzy_mapping(public) else UNKNOWN


def _has_turns(df: DataFrame, column: str, keys: tuple[str, str], strict_first_row: bool) -> bool:
    dtype = df.schema[column].dataType
    if not isinstance(dtype, T.ArrayType):
        return False
    turn = F.get(F.col(f"`{column}`"), F.lit(0))
    if isinstance(dtype.elementType, T.StructType):
        if not set(keys) <= set(dtype.elementType.names):
            return False
        if not strict_first_row:
            return True
        found = turn.isNotNull()
    elif isinstance(dtype.elementType, T.MapType):
        found = F.map_contains_key(turn, keys[0]) & F.map_contains_key(turn, keys[1])
    else:
        return False
    if not strict_first_row:
        # stops at the first row found; a source without any is read to its end
        return bool(df.where(found).limit(1).select(F.lit(1)).collect())
    order = [c for c in POSITION if c in df.columns]
    probed = df.select(found.alias("_found"), *order)
    first = probed.orderBy(*order).limit(1) if order else probed.limit(1)
    return any(row["_found"] for row in first.collect())
