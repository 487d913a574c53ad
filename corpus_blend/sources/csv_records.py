"""CSV records out of files that are split anywhere, inside quoted cells too.

A file is read as lines, in blocks, by many tasks. Whether a line begins inside a quoted cell follows
from all lines before it, but what a line does to that state is known from the line alone: it keeps the
state, turns it, or sets it. Such effects can be composed, so the effects of blocks are worked out first,
composed along each file, and give every block the state it begins with. Lines then become records in the
block they begin in; only records that go on in the next block (one a block at most) are put together
across blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.keys import FILE, ROW, SRC
from corpus_blend.staging import stage

# What stands in one line. A quote opens a cell only as its first character; within, two stand for one;
# after the closing one the cell goes on as plain text up to the next comma.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
OPENS = rf'^{_CELLS}"{_INSIDE}\z'  # begins outside, ends inside
STAYS = rf'^{_INSIDE}(?:\z|"[^,]*+,{_CELLS}"{_INSIDE}\z)'  # begins inside, ends inside

PARSING = {"escape": '"', "mode": "FAILFAST", "multiLine": "true", "lineSep": "\n"}
HEADERS_AT_ONCE = 50  # kinds of headers that one reading of the files tells apart
BLOCK = ["__file", "__start"]


def lines_of(spark: SparkSession, path, base_path: str | None) -> DataFrame:
    """Lines with file, block and order in it, and the columns that folder names give."""
    reader = spark.read.option("lineSep", "\n")
    if base_path:
        reader = reader.option("basePath", base_path)
    lines = reader.text(path)
    return lines.select(
        *[F.col(f"`{c}`") for c in lines.columns if c != "value"],
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("__line"),
    )


def headers_of(lines: DataFrame) -> DataFrame:
    """``__file, header, odd``: the first line of each file, and whether it is no whole header in itself
    (blank, quoted over several lines, or in a file whose lines end otherwise)."""
    header = F.col("header")
    odd = F.rtrim("header").isin("", "\r") | header.rlike(OPENS) | header.rlike(r"\r.")
    first = lines.where("__start = 0").groupBy("__file").agg(F.min_by("__line", "__at").alias("header"))
    return first.withColumn("odd", odd)


def _with_effect(lines: DataFrame) -> DataFrame:
    """``sets`` is the state a line ends in whatever it began with, else null; ``turns`` is 1 if it
    turns the state round."""
    quoted = F.contains("__line", F.lit('"'))
    opens = quoted & F.col("__line").rlike(OPENS)
    stays = ~quoted | F.col("__line").rlike(STAYS)
    known = lines.withColumns({"__opens": opens, "__stays": stays})
    return known.withColumns(
        {
            "__sets": F.when(F.col("__opens") == F.col("__stays"), F.col("__opens")),
            "__turns": (F.col("__opens") & ~F.col("__stays")).cast("int"),
        }
    ).drop("__opens", "__stays")


def _state(sets: Column, turned: Column, begin: Column) -> Column:
    """The state after what was last set (its state, and the turns up to it) and all turns so far."""
    odd = F.coalesce(turned - sets["turned"], turned) % 2 != 0
    return F.coalesce(sets["state"], begin) != odd


def _follow(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, Column, Column]:
    """Rows with their running turns, and the last set state and the turns before each row."""
    window = Window.partitionBy(*keys).orderBy(order)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__turned", F.sum("__turns").over(so_far).cast("bigint"))
    last = F.struct(F.col("__sets").alias("state"), F.col("__turned").alias("turned"))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    last_set = F.last(F.when(F.col("__sets").isNotNull(), last), ignorenulls=True).over(before)
    return rows, last_set, F.col("__turned") - F.col("__turns")


def block_states(lines: DataFrame) -> DataFrame:
    """``__file, __start, begins, ends``: whether a block begins and ends inside a quoted cell.

    Only lines that do something to the state are sorted, without their text.
    """
    narrow = stage(_with_effect(lines).select(*BLOCK, "__at", "__sets", "__turns"), "csv-lines")
    acting, last_set, _ = _follow(narrow.where("__sets is not null or __turns = 1"), BLOCK, "__at")
    effect = F.struct(
        F.coalesce(F.when(F.col("__sets").isNotNull(), F.col("__sets")), _state(F.col("__last"), F.col("__turned"), F.lit(None).cast("boolean"))).alias("sets"),
        F.col("__turned").alias("turns"),
    )
    of_blocks = acting.withColumn("__last", last_set).groupBy(*BLOCK).agg(F.max_by(effect, "__at").alias("effect"))
    blocks = narrow.select(*BLOCK).groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n")).join(of_blocks, BLOCK, "left")
    composed = blocks.select(
        *BLOCK, F.col("effect.sets").alias("__sets"), F.coalesce(F.col("effect.turns") % 2, F.lit(0)).cast("int").alias("__turns")
    )
    composed, last_set, turned = _follow(composed, ["__file"], "__start")
    outside = F.lit(False)
    begun = composed.withColumns({"__last": last_set, "__before": turned})
    begun = begun.withColumn("begins", _state(F.col("__last"), F.col("__before"), outside))
    along = Window.partitionBy("__file").orderBy("__start")
    begun = begun.withColumn("ends", F.lead("begins", 1, False).over(along))
    return begun.select(*BLOCK, "begins", "ends")


def pieces_of(lines: DataFrame, states: DataFrame, kept: list[str]) -> DataFrame:
    """Records, and pieces of those that go over the end of a block.

    ``__record`` counts records in a block; 0 is the rest of one that began in an earlier block.
    ``__open`` marks what goes on in the next block.
    """
    joined = _with_effect(lines).join(states, BLOCK)
    rows, last_set, before = _follow(joined, BLOCK, "__at")
    rows = rows.withColumns({"__last": last_set, "__before": before})
    inside = _state(F.col("__last"), F.col("__before"), F.col("begins"))
    order = Window.partitionBy(*BLOCK).orderBy("__at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__begins", (~inside).cast("int"))
    rows = rows.withColumn("__record", F.sum("__begins").over(so_far))
    rows = rows.withColumn("__last_line", F.lead("__at").over(order).isNull())
    texts = F.array_sort(F.collect_list(F.struct("__at", "__line")))
    return rows.groupBy(*BLOCK, "__record").agg(
        F.array_join(F.transform(texts, lambda x: x["__line"]), "\n").alias("__text"),
        F.min("__at").alias("__at"),
        F.max(F.col("__last_line") & F.col("ends")).alias("__open"),
        *[F.first(f"`{c}`").alias(c) for c in kept],
    )


def _joined_pieces(pieces: DataFrame, kept: list[str]) -> DataFrame:
    """Records whose lines lie in several blocks. There are two pieces a block at most."""
    order = Window.partitionBy("__file").orderBy("__start", "__record")
    begins = (F.col("__record") > 0).cast("int")
    numbered = pieces.withColumn("__whole", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("__start", "__text")))
    return numbered.groupBy("__file", "__whole").agg(
        F.array_join(F.transform(parts, lambda x: x["__text"]), "\n").alias("__text"),
        F.min("__start").alias("__start"),
        F.min(F.when(F.col("__record") > 0, F.col("__at"))).alias("__at"),
        F.first("__record").alias("__record"),
        *[F.first(f"`{c}`").alias(c) for c in kept],
    )


def read_records(
    spark: SparkSession,
    path,
    headers: dict[str, T.StructType],
    of_files: DataFrame,
    base_path: str | None,
    multi_line: bool,
    write: bool,
) -> DataFrame:
    """All records as columns, with a position: file and block, then order in the block.

    ``headers`` gives the columns for each first line that occurs; every file is read by its own, and
    a column that a file lacks is null; ``of_files`` are the files' first lines. With ``write`` the rows are written to the shared folder as they
    are read, so that positions stay what they are.
    """
    lines = lines_of(spark, path, base_path)
    kept = [c for c in lines.columns if not c.startswith("__")]
    states = stage(block_states(lines), "csv-blocks") if multi_line else None
    known = list(headers.items())
    frames = []
    for at in range(0, len(known), HEADERS_AT_ONCE):
        some = dict(known[at : at + HEADERS_AT_ONCE])
        files = of_files.where(F.col("header").isin(*some)).select("__file", "header")
        mine = lines if len(known) <= HEADERS_AT_ONCE else lines.join(files.select("__file"), "__file", "left_semi")
        frames.append(_read(mine, files, states, some, kept, write))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    places = (SRC, FILE, ROW)
    return rows.select(*[c for c in rows.columns if c not in places], *places)


def _read(lines, files, states, headers, kept, write) -> DataFrame:
    if states is None:
        heads = lines.where("__start = 0").groupBy("__file").agg(F.min("__at").alias("__at"))
        found = lines.join(heads, ["__file", "__at"], "left_anti")
        rows = _parsed(found.withColumnRenamed("__line", "__text"), files, headers, kept)
        return stage(rows, "csv-rows") if write else rows
    pieces = pieces_of(lines, states, kept)
    whole = (F.col("__record") > 0) & ~F.col("__open")
    marked = _parsed(pieces.withColumn("__piece", ~whole), files, headers, kept + ["__piece", "__record", "__at"])
    if write:
        marked = stage(marked, "csv-rows")
    rows = marked.where("not __piece").drop("__piece", "__record", "__at", "__raw", "__start", "__file")
    split = marked.where("__piece").select(*BLOCK, "__record", "__at", F.col("__raw").alias("__text"), *kept)
    rest = _parsed(_joined_pieces(split, kept), files, headers, kept)
    return rows.unionByName(rest)


def _parsed(records: DataFrame, files: DataFrame, headers: dict, kept: list[str]) -> DataFrame:
    """Cells by the header of their file; headers, blank lines and pieces (kept raw) are no rows."""
    known = records.join(files, "__file")
    marks = "__piece" in kept
    if "__record" in records.columns:
        known = known.where("not (__start = 0 and __record = 1)")
    text = F.col("__text")
    breaks = F.endswith("header", F.lit("\r"))
    clean = F.when(breaks, F.replace(F.regexp_replace(text, r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    known = known.withColumn("__clean", F.when(~F.col("__piece"), clean) if marks else clean)
    known = known.where("__piece or __clean <> ''" if marks else "__clean <> ''")
    cells = {}
    for i, (header, schema) in enumerate(headers.items()):
        mine = F.col("__clean") if len(headers) == 1 else F.when(F.col("header") == header, F.col("__clean"))
        cells[f"__cells{i}"] = F.from_csv(mine, _ddl(schema), PARSING)
    known = known.withColumns(cells)
    columns: dict[str, list[Column]] = {}
    for i, schema in enumerate(headers.values()):
        for f in schema:
            if f.name not in kept:  # what a folder's name says comes before a cell
                columns.setdefault(f.name, []).append(F.col(f"__cells{i}").getField(f.name))
    place = F.concat("__file", F.lit("#"), F.lpad(F.col("__start").cast("string"), 20, "0"))
    return known.select(
        *[F.coalesce(*found).alias(name) for name, found in columns.items()],
        *[F.col(f"`{c}`") for c in kept],
        *([F.col("__text").alias("__raw"), *BLOCK] if marks else []),
        F.lit(0).alias(SRC),
        place.alias(FILE),
        F.col("__at").alias(ROW),
    )


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
