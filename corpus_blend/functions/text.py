"""Turning a column of any type into plain text, and the text helpers built on it.

The shape of a value is resolved from the column's data type while the plan is
built, so a string column costs one ``coalesce`` and nothing is decided per row
except for maps and for JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters counted as whitespace (the Unicode set, spelled
# out because Java's \s is ASCII only), and the keys that carry a value's text.
OTHER_SPACES = (
    r"\t\n\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WHITESPACE = " " + OTHER_SPACES
BLOCK_KEYS = ("text", "content")
VALUE_KEYS = ("text", "content", "value")
PART_SEPARATOR = "\n"

JSON_DEPTH = 16  # an expression cannot recurse: so many levels are written out, deeper ones folded


def to_text(col: Column, dtype: T.DataType, json_content: bool = False) -> Column:
    """Plain, never-null text of a column of type ``dtype``.

    With ``json_content`` strings that hold a JSON list or object are read as
    such; a JSON reader leaves them behind when a field mixes shapes.
    """
    if isinstance(dtype, T.NullType):
        return F.lit("")
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return _json_or_text(col) if json_content else F.coalesce(col, F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False").otherwise("")
    if isinstance(dtype, T.ArrayType):
        return _lines(col, lambda x: _block_text(x, dtype.elementType, json_content))
    if isinstance(dtype, T.StructType):
        key = _first_of(VALUE_KEYS, dtype)
        if key:
            return to_text(col.getField(key), dtype[key].dataType, json_content)
        return F.when(col.isNull(), "").otherwise(json_text(col, dtype))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        return _by_key(
            col,
            VALUE_KEYS,
            lambda v: to_text(v, dtype.valueType, json_content),
            F.when(col.isNull(), "").otherwise(json_text(col, dtype)),
        )
    if isinstance(dtype, T.MapType):
        return F.when(col.isNull(), "").otherwise(json_text(col, dtype))
    if isinstance(dtype, T.VariantType):
        return _variant_text(col, JSON_DEPTH)
    return F.coalesce(col.cast("string"), F.lit(""))


def _first_of(keys: tuple[str, ...], dtype: T.StructType) -> str | None:
    return next((k for k in keys if k in dtype.names), None)


def _lines(col: Column, item) -> Column:
    texts = F.filter(F.transform(col, item), lambda t: t != "")
    return F.coalesce(F.array_join(texts, PART_SEPARATOR), F.lit(""))


def _by_key(col: Column, keys: tuple[str, ...], text, otherwise: Column) -> Column:
    """First key present in a map decides, even where its value is null."""
    chosen = otherwise
    for key in reversed(keys):
        chosen = F.when(F.map_contains_key(col, key), text(F.element_at(col, key))).otherwise(
            chosen
        )
    return chosen


def _is_text_part(kind: Column) -> Column:
    return kind.isNull() | (kind == "text")


def _block_text(item: Column, dtype: T.DataType, json_content: bool) -> Column:
    """Text of one list item; a part that is not text gives "" and is dropped."""
    if isinstance(dtype, T.StructType):
        key = _first_of(BLOCK_KEYS, dtype)
        if key:
            return to_text(item.getField(key), dtype[key].dataType, json_content)
        whole = to_text(item, dtype, json_content)
        if "type" not in dtype.names:
            return whole
        kind = item.getField("type").cast("string")
        return F.when(_is_text_part(kind), whole).otherwise("")
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        kind = F.element_at(item, "type").cast("string")
        return _by_key(
            item,
            BLOCK_KEYS,
            lambda v: to_text(v, dtype.valueType, json_content),
            F.when(_is_text_part(kind), to_text(item, dtype, json_content)).otherwise(""),
        )
    return to_text(item, dtype, json_content)


# --- JSON text of nested values ------------------------------------------------


def _quoted(col: Column) -> Column:
    listed = F.to_json(F.array(col.cast("string")))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_text(col: Column, dtype: T.DataType) -> Column:
    """JSON with ", " and ": " between items, nulls kept and non-ASCII unescaped."""
    if isinstance(dtype, T.StructType):
        members = [
            F.concat(_quoted(F.lit(f.name)), F.lit(": "), json_text(col.getField(f.name), f.dataType))
            for f in dtype
        ]
        body = F.concat_ws(", ", *members) if members else F.lit("")
        text = F.concat(F.lit("{"), body, F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: json_text(x, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.concat(
                _quoted(e.getField("key")),
                F.lit(": "),
                json_text(e.getField("value"), dtype.valueType),
            ),
        )
        text = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    elif isinstance(dtype, T.BooleanType) or isinstance(dtype, T.NumericType):
        text = col.cast("string")
    elif isinstance(dtype, T.VariantType):
        text = F.to_json(col)
    else:
        text = _quoted(col)
    return F.coalesce(F.when(col.isNotNull(), text), F.lit("null"))


# --- strings that hold JSON ------------------------------------------------------


def _json_or_text(col: Column) -> Column:
    """A string, or the text of the JSON list or object it holds."""
    parsed = F.when(col.rlike(r"^\s*[\[{]"), F.try_parse_json(col))

    def text(v: Column) -> Column:
        # an object without a text key is a message that happens to be JSON: it stays as written
        members = F.try_variant_get(v, "$", "map<string,variant>")
        held = [F.coalesce(F.map_contains_key(members, k), F.lit(False)) for k in VALUE_KEYS]
        bare = F.schema_of_variant(v).startswith("OBJECT") & ~held[0] & ~held[1] & ~held[2]
        return F.when(v.isNotNull() & ~bare, _variant_text(v, JSON_DEPTH)).otherwise(
            F.coalesce(col, F.lit(""))
        )

    return _once(parsed, text)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _variant_text(value: Column, depth: int, listed: Column | None = None) -> Column:
    """Text of a parsed JSON value; lists and objects nested more than ``depth`` deep are read off
    their JSON text instead, to the same result.

    A list has its items as children, an object the value of its first text
    key. ``listed`` tells whether the value is itself an item of a list.
    """
    kind = F.schema_of_variant(value)
    is_list, is_object = kind.startswith("ARRAY"), kind.startswith("OBJECT")
    plain = F.try_variant_get(value, "$", "string")
    scalar = F.when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)
    members = F.try_variant_get(value, "$", "map<string,variant>")
    if depth == 0:
        text = F.when(is_list | is_object, _once(F.to_json(value), _folded)).otherwise(scalar)
    else:
        child = F.lit(None)
        for key in reversed(VALUE_KEYS):
            found = F.map_contains_key(members, key)
            child = F.when(found, F.array(F.element_at(members, key))).otherwise(child)
        children = F.when(is_list, F.try_variant_get(value, "$", "array<variant>")).otherwise(child)
        text = F.when(
            children.isNotNull(), _lines(children, lambda x: _variant_text(x, depth - 1, is_list))
        ).otherwise(F.when(is_object, F.to_json(value)).otherwise(scalar))
    if listed is not None:
        held = [F.coalesce(F.map_contains_key(members, k), F.lit(False)) for k in BLOCK_KEYS]
        part = F.try_variant_get(value, "$.type", "string")
        dropped = is_object & ~held[0] & ~held[1] & ~_is_text_part(part)
        text = F.when(listed & dropped, "").otherwise(text)
    return F.coalesce(text, F.lit(""))


# What is open at a token of JSON text: a list with its items' texts, or an object with the key that
# waits for its value, the first of the text keys so far (its rank and text), and what decides whether
# it is a part with text. ``start`` is where it begins.
_FRAME = (
    "struct<list:boolean,parts:array<string>,key:string,rank:int,text:string,type:string,named:boolean,start:int>"
)
_FOLD = f"struct<open:array<{_FRAME}>,at:int,text:string>"
_TOKENS = r'("(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^"\[\]{}:,]++)'


def _folded(json: Column) -> Column:
    """Text of a JSON list or object of any depth: one pass over its tokens with a stack."""
    start = F.struct(F.array(), F.lit(0), F.lit(None)).cast(_FOLD)
    tokens = F.regexp_extract_all(json, F.lit(_TOKENS), F.lit(1))
    return F.aggregate(tokens, start, lambda s, t: _step(s, t, json), lambda s: s["text"])


def _last(stack: Column) -> Column:
    return F.get(stack, F.size(stack) - 1)


def _but_last(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def _step(state: Column, token: Column, json: Column) -> Column:
    stack, after = state["open"], state["at"] + F.length(token)

    def moved(to: Column, text: Column) -> Column:
        return F.struct(to.alias("open"), after.alias("at"), text.alias("text")).cast(_FOLD)

    def within(top: Column) -> Column:
        opened = F.struct(
            (token == "[").alias("list"), F.array().cast("array<string>"), F.lit(None), F.lit(None), F.lit(None),
            F.lit(None), F.lit(False), state["at"],
        ).cast(_FRAME)
        keyed = F.struct(
            *[(_unquoted(token) if n == "key" else top[n]).alias(n) for n in ("list", "parts", "key", "rank", "text", "type", "named", "start")]
        ).cast(_FRAME)
        closes = token.isin("]", "}")
        below = F.when(closes, _but_last(stack)).otherwise(stack)
        holder = _last(below)
        value = F.when(closes, _closed_text(top, holder, after, json)).otherwise(_scalar_text(token))
        is_key = ~top["list"] & top["key"].isNull() & F.startswith(token, F.lit('"'))
        done = F.when(F.size(below) == 0, moved(below, value)).otherwise(
            moved(F.concat(_but_last(below), F.array(_holding(holder, value, token))), state["text"])
        )
        return (
            F.when(token.isin("[", "{"), moved(F.concat(stack, F.array(opened)), state["text"]))
            .when(token.isin(":", ","), moved(stack, state["text"]))
            .when(is_key, moved(F.concat(_but_last(stack), F.array(keyed)), state["text"]))
            .otherwise(done)
        )

    return _once(_last(stack), within)


def _unquoted(token: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def _scalar_text(token: Column) -> Column:
    plain = _unquoted(token)
    return F.coalesce(F.when(token.isin("true", "false"), F.initcap(plain)).otherwise(plain), F.lit(""))


def _closed_text(frame: Column, holder: Column, after: Column, json: Column) -> Column:
    listed = F.array_join(F.filter(frame["parts"], lambda t: t != ""), PART_SEPARATOR)
    whole = F.substring(json, frame["start"] + 1, after - frame["start"])
    member = F.when(frame["rank"].isNotNull(), frame["text"]).otherwise(whole)
    dropped = F.coalesce(holder["list"], F.lit(False)) & ~frame["named"] & ~_is_text_part(frame["type"])
    return F.when(frame["list"], listed).when(dropped, "").otherwise(member)


def _holding(frame: Column, value: Column, token: Column) -> Column:
    """The frame around a value, with that value taken in."""
    key, rank = frame["key"], F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(VALUE_KEYS))):
        rank = F.when(key == name, i).otherwise(rank)
    first = ~frame["list"] & rank.isNotNull() & (frame["rank"].isNull() | (rank < frame["rank"]))
    kind = F.when(token.isin("]", "}"), token).otherwise(_unquoted(token))
    return F.struct(
        frame["list"].alias("list"),
        F.when(frame["list"], F.concat(frame["parts"], F.array(value))).otherwise(frame["parts"]).alias("parts"),
        F.lit(None).cast("string").alias("key"),
        F.when(first, rank).otherwise(frame["rank"]).alias("rank"),
        F.when(first, value).otherwise(frame["text"]).alias("text"),
        F.when(key == "type", kind).otherwise(frame["type"]).alias("type"),
        (frame["named"] | F.coalesce(key.isin(*BLOCK_KEYS), F.lit(False))).alias("named"),
        frame["start"].alias("start"),
    ).cast(_FRAME)


# --- small text helpers -----------------------------------------------------------


# whitespace but the plain space; the range in front rules most characters out at once
_BREAK = f"[[\\x00-\\x1f\\x{{85}}-\\x{{3000}}]&&[{OTHER_SPACES}]]"
_MARK = "\x1c"  # whitespace itself, so none is left when it is used


def _single_spaces(col: Column) -> Column:
    """Runs of spaces to one: each space gets a mark behind it, marks before a space take that
    space with them, the others go. Plain replacements are several times faster than a pattern."""
    space, mark, nothing = F.lit(" "), F.lit(_MARK), F.lit("")
    marked = F.replace(col, space, F.lit(" " + _MARK))
    first = F.replace(marked, F.lit(_MARK + " "), nothing)
    return F.when(F.contains(col, F.lit("  ")), F.replace(first, mark, nothing)).otherwise(col)


def normalize_text(col: Column) -> Column:
    """Whitespace runs to one space, no space at the ends, lower case."""
    spaced = F.regexp_replace(F.coalesce(col, F.lit("")), _BREAK, " ")
    return F.lower(F.trim(_single_spaces(spaced)))


def is_blank(col: Column) -> Column:
    """Null, empty or whitespace only; stops reading at the first other character."""
    return ~F.coalesce(col, F.lit("")).rlike(f"[^{WHITESPACE}]")


def title_case(col: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")
