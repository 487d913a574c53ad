"""Rewriting a source into the shape its layout stands for, then into the target shape."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.chat import (
    CHATML,
    MESSAGES_TYPE,
    PREFERENCE,
    PREFERENCE_FIELDS,
    TEXT,
    check_target,
    message,
    messages_to_text,
    normalize_role,
    row_is_blank,
)
from corpus_blend.functions.keys import POSITION
from corpus_blend.functions.text import to_text
from corpus_blend.operators.detect import FUZZY, UNKNOWN, fuzzy_mapping, validate_format

# The column each role is read from, the settings that rename
# them, and the provenance columns.
QUESTION_ANSWER = {
    "alpaca": ("instruction", "input", "output"),
    "prompt_completion": ("prompt", None, "completion"),
    "qa": ("question", None, "answer"),
    "input_output": ("input", None, "output"),
}
COMPLETION_FALLBACK = "response"
TURN_FIELDS = {
    "sharegpt": ("conversations", "from", "value"),
    "chatml": ("messages", "role", "content"),
}
TEXT_COLUMNS = ("text", "content")
COLUMN_SETTINGS = (
    "instruction_key",
    "input_key",
    "output_key",
    "prompt_key",
    "completion_key",
    "question_key",
    "answer_key",
    "conversations_key",
    "messages_key",
    "text_key",
    "chosen_key",
    "rejected_key",
    "mapping",
)
DEFAULT_ROLE = "user"
PROVENANCE = ("source_dataset", "source_split")


def validate_columns(columns: dict | None) -> dict:
    columns = dict(columns or {})
    unknown = sorted(set(columns) - set(COLUMN_SETTINGS))
    if unknown:
        raise ValueError(
            f"unknown column settings {', '.join(unknown)} (use {', '.join(COLUMN_SETTINGS)})"
        )
    return columns


class _Fields:
    """Reads columns by exact name; a name the source lacks reads as empty text."""

    def __init__(self, df: DataFrame, columns: dict, json_content: bool, case_insensitive: bool):
        self.schema = df.schema
        self.columns = columns
        self.json_content = json_content
        self.lowered = {c.lower(): c for c in df.columns} if case_insensitive else {}

    def find(self, name: str | None) -> str | None:
        if name is None or name in self.schema.names:
            return name
        return self.lowered.get(name.lower())

    def named(self, role: str) -> str:
        return self.columns.get(f"{role}_key") or role

    def text(self, name: str | None) -> Column:
        column = self.find(name)
        if column is None:
            return F.lit("")
        return to_text(F.col(f"`{column}`"), self.schema[column].dataType, self.json_content)

    def turns(self, name: str, role_field: str, content_field: str) -> Column:
        column = self.find(name)
        dtype = self.schema[column].dataType if column else None
        element = dtype.elementType if isinstance(dtype, T.ArrayType) else None
        if not isinstance(element, (T.StructType, T.MapType)):
            return F.array().cast(MESSAGES_TYPE)

        def member(turn: Column, field: str) -> tuple[Column, T.DataType] | None:
            if isinstance(element, T.MapType):
                return F.element_at(turn, field), element.valueType
            if field in element.names:
                return turn.getField(field), element[field].dataType
            return None

        def turn_message(turn: Column) -> Column:
            role = member(turn, role_field)
            content = member(turn, content_field)
            speaker = F.lit(DEFAULT_ROLE)
            if role:
                speaker = normalize_role(role[0].cast("string"))
                if isinstance(element, T.MapType):
                    present = F.map_contains_key(turn, role_field)
                    speaker = F.when(present, speaker).otherwise(DEFAULT_ROLE)
            said = to_text(*content, self.json_content) if content else F.lit("")
            return message(speaker, said)

        turns = F.filter(F.col(f"`{column}`"), lambda t: t.isNotNull())
        return F.coalesce(
            F.transform(turns, turn_message).cast(MESSAGES_TYPE), F.array().cast(MESSAGES_TYPE)
        )


def _question(question: Column, context: Column | None) -> Column:
    if context is None:
        return question
    return F.when(context == "", question).otherwise(F.concat(question, F.lit("\n\n"), context))


def _exchange(question: Column, answer: Column) -> Column:
    return F.array(message("user", question), message("assistant", answer)).cast(MESSAGES_TYPE)


def _natural_shape(fmt: str, fields: _Fields) -> dict[str, Column]:
    """Columns of the layout's own shape: messages, text, or a preference pair."""
    if fmt in TURN_FIELDS:
        column, role, content = TURN_FIELDS[fmt]
        return {"messages": fields.turns(fields.named(column), role, content)}
    if fmt == "text":
        present = next((c for c in TEXT_COLUMNS if fields.find(c)), TEXT_COLUMNS[-1])
        return {"text": fields.text(fields.columns.get("text_key") or present)}
    if fmt == "preference":
        return {name: fields.text(fields.named(name)) for name in PREFERENCE_FIELDS}
    if fmt == FUZZY:
        public = [c for c in fields.schema.names if c not in POSITION]
        roles = fields.columns.get("mapping")
        roles = (fuzzy_mapping(public) or {}) if roles is None else roles
        question, context, answer = (roles.get(r) for r in QUESTION_ANSWER["alpaca"])
    else:
        question, context, answer = (r and fields.named(r) for r in QUESTION_ANSWER[fmt])
        chosen = fields.columns.get("completion_key")
        if fmt == "prompt_completion" and not chosen and fields.find(answer) is None:
            answer = COMPLETION_FALLBACK
    asked = _question(fields.text(question), fields.text(context) if context else None)
    return {"messages": _exchange(asked, fields.text(answer))}


def _target_shape(shape: dict[str, Column], fmt: str, target: str, label: str) -> dict[str, Column]:
    if target == PREFERENCE and "chosen" not in shape:
        raise ValueError(
            f"{label}: the target is 'preference' but this source was read as {fmt!r} and has no "
            "chosen and rejected columns"
        )
    if target != PREFERENCE and "chosen" in shape:
        shape = {"messages": _exchange(shape["prompt"], shape["chosen"])}
    if target == TEXT and "messages" in shape:
        return {"text": messages_to_text(shape["messages"])}
    if target == CHATML and "text" in shape:
        return {"messages": F.array(message("assistant", shape["text"])).cast(MESSAGES_TYPE)}
    return shape


def _shape(df, fmt, columns, json_content, case_insensitive, label) -> dict[str, Column]:
    if fmt == UNKNOWN:
        public = [c for c in df.columns if c not in POSITION]
        raise ValueError(
            f"the layout of {label!r} is not recognised (columns: {', '.join(public)}); "
            "give its format and columns"
        )
    fields = _Fields(df, validate_columns(columns), json_content, case_insensitive)
    return _natural_shape(validate_format(fmt), fields)


def _project(df: DataFrame, shape: dict[str, Column], keep: Iterable[str]) -> DataFrame:
    hidden = [c for c in POSITION if c in df.columns]
    kept = [c for c in keep if c not in hidden]
    return df.select(*kept, *[c.alias(name) for name, c in shape.items()], *hidden)


def standardize(
    df: DataFrame,
    fmt: str,
    columns: dict | None = None,
    keep: Iterable[str] = (),
    json_content: bool = False,
    case_insensitive: bool = False,
) -> DataFrame:
    """The source in the shape of its layout: ``messages``, ``text``, or a preference pair."""
    shape = _shape(df, fmt, columns, json_content, case_insensitive, "source")
    return _project(df, shape, keep)


def blank_after(df: DataFrame, fmt: str, columns: dict | None = None) -> Column:
    """Whether standardizing a row leaves no content."""
    shape = _shape(df, fmt, columns, False, False, "source")
    kind = CHATML if "messages" in shape else PREFERENCE if "chosen" in shape else TEXT
    return row_is_blank(kind, shape)


def to_target(
    df: DataFrame,
    fmt: str,
    target: str,
    label: str = "unknown source",
    split: str = "train",
    columns: dict | None = None,
    keep: Iterable[str] = (),
    json_content: bool = False,
    case_insensitive: bool = False,
) -> DataFrame:
    """The source in a target shape, with where it came from; every other column is dropped."""
    shape = _shape(df, fmt, columns, json_content, case_insensitive, label)
    shape = _target_shape(shape, fmt, check_target(target), label)
    origin = dict(zip(PROVENANCE, (F.lit(label), F.lit(split))))
    return _project(df, {**shape, **origin}, keep)
