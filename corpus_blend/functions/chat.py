"""Expressions over the three target shapes: chat messages, plain text, preference pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_blend.functions.text import is_blank, normalize_text, title_case

# Target names, role spellings, headings and separators.
CHATML = "chatml"
TEXT = "text"
PREFERENCE = "preference"
TARGETS = (CHATML, TEXT, PREFERENCE)
ROLES = {
    "human": "user",
    "gpt": "assistant",
    "system": "system",
    "user": "user",
    "assistant": "assistant",
    "bot": "assistant",
    "chatbot": "assistant",
    "ai": "assistant",
}
HEADINGS = {"user": "Instruction", "assistant": "Response"}
TURN_SEPARATOR = "\n\n"
HASH_SEPARATOR = "||"
PREVIEW_CHARS = 140
PREFERENCE_FIELDS = ("prompt", "chosen", "rejected")

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def check_target(target: str) -> str:
    if target not in TARGETS:
        raise ValueError(f"unknown target format {target!r} (use one of {', '.join(TARGETS)})")
    return target


def message(role, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def as_messages(messages: Column) -> Column:
    """A list of messages with its fields in the usual order; JSON readers sort them by name."""
    ordered = F.transform(messages, lambda m: message(m.getField("role"), m.getField("content")))
    return F.coalesce(ordered.cast(MESSAGES_TYPE), F.array().cast(MESSAGES_TYPE))


def normalize_role(role: Column) -> Column:
    """Known spellings become user, assistant or system; others, and null, stay as they are."""
    spellings: dict[str, list[str]] = {}
    for spelling, name in ROLES.items():
        spellings.setdefault(name, []).append(spelling)
    mapped = role
    for name, known in spellings.items():
        mapped = F.when(F.lower(role).isin(known), name).otherwise(mapped)
    return mapped


def messages_to_text(messages: Column) -> Column:
    """One training text: a heading per message, messages apart by a blank line."""

    def section(m: Column) -> Column:
        role = F.coalesce(m.getField("role"), F.lit("user"))
        heading = title_case(role)
        for name, label in HEADINGS.items():
            heading = F.when(role == name, label).otherwise(heading)
        content = F.coalesce(m.getField("content"), F.lit(""))
        return F.concat(F.lit("### "), heading, F.lit(":\n"), content)

    return F.coalesce(F.array_join(F.transform(messages, section), TURN_SEPARATOR), F.lit(""))


def row_length(target: str) -> Column:
    """Characters of a row: all message contents, all three preference fields, or the text."""
    if check_target(target) == CHATML:
        zero = F.lit(0).cast("bigint")
        size = F.aggregate(
            F.col("messages"),
            zero,
            lambda acc, m: acc + F.length(F.coalesce(m.getField("content"), F.lit(""))),
        )
        return F.coalesce(size, zero)
    fields = PREFERENCE_FIELDS if target == PREFERENCE else ("text",)
    lengths = [F.length(F.coalesce(F.col(f), F.lit(""))).cast("bigint") for f in fields]
    return sum(lengths[1:], lengths[0])


def row_payload(target: str, normalize: bool = False, strict: bool = False) -> Column:
    """The text that identifies a row. ``strict`` puts each part's length in front of it,
    so that no two different rows can give the same payload."""
    clean = normalize_text if normalize else (lambda c: F.coalesce(c, F.lit("")))

    def part(c: Column) -> Column:
        return F.concat(F.length(c).cast("string"), F.lit("/"), c) if strict else c

    if check_target(target) == CHATML:
        turns = F.transform(
            F.col("messages"),
            lambda m: F.concat(
                part(F.coalesce(m.getField("role"), F.lit("None"))),
                F.lit(":"),
                part(clean(m.getField("content"))),
            ),
        )
        return F.coalesce(F.array_join(turns, HASH_SEPARATOR), F.lit(""))
    if target == PREFERENCE:
        return F.concat_ws(HASH_SEPARATOR, *[part(clean(F.col(f))) for f in PREFERENCE_FIELDS])
    return clean(F.col("text"))


def row_hash(target: str, normalize: bool = False, strict: bool = False) -> Column:
    return F.sha2(row_payload(target, normalize, strict), 256)


def row_is_blank(target: str, shape: dict[str, Column] | None = None) -> Column:
    """No message with content; a blank side of a pair; a blank text."""
    shape = shape or {}
    if check_target(target) == CHATML:
        messages = shape.get("messages", F.col("messages"))
        blank = F.forall(messages, lambda m: is_blank(m.getField("content")))
        return F.coalesce(blank, F.lit(True))
    if target == PREFERENCE:
        sides = [shape.get(side, F.col(side)) for side in ("chosen", "rejected")]
        return is_blank(sides[0]) | is_blank(sides[1])
    return is_blank(shape.get("text", F.col("text")))


def row_preview(target: str) -> Column:
    """Opening characters shown in reports."""
    if check_target(target) == CHATML:
        shown = F.get(F.col("messages"), F.lit(0)).getField("content")
    else:
        shown = F.col("prompt" if target == PREFERENCE else "text")
    return F.substring(F.coalesce(shown, F.lit("")), 1, PREVIEW_CHARS)
