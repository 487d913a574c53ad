"""Records out of JSON lists, by many tasks a file.

A file is read in pieces that end with a closing brace, in blocks. Whether a brace or bracket counts follows
from all text before it, as it may stand in a string. But what a piece does is known from the piece alone:
with an odd number of quotes it turns inside and outside round, and it changes the depth by one number if it
begins outside of strings, by another if it begins inside. The effects of pieces are added up by block and
composed along each file, so that every block knows the state it begins with. A piece that leads back to
depth 1 ends a record. Only records that go on in the next block (one a block at most) are put together
across blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.keys import FILE, ROW, SRC
from corpus_blend.staging import new_folder, stage

BLOCK = ["__file", "__start"]
RECORD_END = "\x1e"  # ends written records; JSON allows it in no string and between no values
SPACE = r"[ \t\r\n]*+"
FIRST = rf"(?s)^{SPACE}\[{SPACE}(\{{.*)$"
NEXT = rf"(?s)^{SPACE},{SPACE}(\{{.*)$"
LAST = rf"(?s)^{SPACE}(?:\[{SPACE})?\]{SPACE}$"


def pieces_of(spark: SparkSession, path, base_path: str | None) -> DataFrame:
    """Pieces without their closing brace, with file, block and order in it, and folder columns."""
    reader = spark.read.option("lineSep", "}")
    if base_path:
        reader = reader.option("basePath", base_path)
    pieces = reader.text(path)
    return pieces.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c != "value"],
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("__piece"),
    )


def may_split(spark: SparkSession, path) -> bool:
    """Whether a file is long enough for Spark to cut it; only names and lengths are read."""
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return (longest or 0) > _bytes(spark.conf.get("spark.sql.files.openCostInBytes"))


def _bytes(size: str) -> int:
    """A size as settings spell it: a number, or one with a unit."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << (10 * " kmgt".index(unit or " "))


def _count(text: Column, characters: str) -> Column:
    """How many of these characters a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _with_effect(pieces: DataFrame) -> DataFrame:
    """``__turns`` is 1 for an odd number of quotes; ``__out`` and ``__in`` are what the piece and the brace
    after it add to the depth if it begins outside or inside a string."""
    plain = F.when(F.contains("__piece", F.lit("\\")), F.regexp_replace("__piece", r"(?s)\\.", "")).otherwise(F.col("__piece"))
    return (
        pieces.withColumn("__marks", F.split(plain, '"'))
        .withColumn("__turns", (F.size("__marks") + 1) % 2)
        .withColumn("__out", _depth(0) - (1 - F.col("__turns")))
        .withColumn("__in", _depth(1) - F.col("__turns"))
        .drop("__marks")
    )


def _depth(first: int) -> Column:
    """What the stretches between quotes add to the depth, every other one from ``first`` on."""
    stretches = F.array_join(F.filter("__marks", lambda _, i: i % 2 == first), "")
    return (_count(stretches, "[{") - _count(stretches, "]}")).cast("bigint")


def _added(inside: Column) -> Column:
    return F.when(inside, F.col("__in")).otherwise(F.col("__out"))


def _before(window) -> object:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _sum(column, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def block_states(pieces: DataFrame) -> DataFrame:
    """``__file, __start, inside, depth``: the state in which a block begins; and for its file ``whole``, whether
    it ends where its list does, and ``list``, whether it begins as one."""
    opened = F.when(F.col("__start") == 0, F.col("__piece").rlike(rf"^{SPACE}\["))
    narrow = _with_effect(pieces).select(*BLOCK, "__at", "__turns", "__out", "__in", opened.alias("__opened"))
    turned = _sum("__turns", _before(Window.partitionBy(*BLOCK).orderBy("__at"))) % 2 == 1
    # the block as it is if it begins outside, and if it begins inside
    effects = narrow.withColumn("__turned", turned).groupBy(*BLOCK).agg(
        (F.sum("__turns") % 2).alias("__turns"),
        F.sum(_added(F.col("__turned"))).alias("__out"),
        F.sum(_added(~F.col("__turned"))).alias("__in"),
        F.min_by("__opened", "__at").alias("__opened"),
    )
    along = Window.partitionBy("__file").orderBy("__start")
    known = effects.withColumn("inside", _sum("__turns", _before(along)) % 2 == 1)
    known = known.withColumn("__added", _added(F.col("inside")))
    known = known.withColumn("depth", _sum("__added", _before(along)))
    every = Window.partitionBy("__file")
    # the last piece is what follows the last brace, and was counted as if one followed it
    whole = (F.sum("__turns").over(every) % 2 == 0) & (F.sum("__added").over(every) == -1)
    begins = F.max("__opened").over(every)
    return known.select(*BLOCK, "inside", "depth", whole.alias("whole"), begins.alias("list"))


def parts_of(pieces: DataFrame, states: DataFrame, kept: list[str]) -> DataFrame:
    """Records, and parts of those that go over the end of a block.

    ``__begun`` says whether a part begins its record, ``__ended`` whether it ends it.
    """
    joined = _with_effect(pieces).join(states.drop("whole", "list"), BLOCK)
    order = Window.partitionBy(*BLOCK).orderBy("__at")
    rows = joined.withColumn("__turned", (_sum("__turns", _before(order)) + F.col("inside").cast("int")) % 2 == 1)
    rows = rows.withColumn("__added", _added(F.col("__turned")))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__depth", F.col("depth") + F.sum("__added").over(so_far))
    outside = F.col("__turned") == (F.col("__turns") == 1)
    rows = rows.withColumn("__ends", outside & (F.col("__depth") == 1))
    rows = rows.withColumn("__record", _sum(F.col("__ends").cast("int"), _before(order)))
    texts = F.array_sort(F.collect_list(F.struct("__at", "__piece")))
    begins = (F.col("__start") == 0) | (~F.col("inside") & (F.col("depth") == 1))
    return rows.groupBy(*BLOCK, "__record").agg(
        F.array_join(F.transform(texts, lambda x: x["__piece"]), "}").alias("__text"),
        F.min("__at").alias("__at"),
        F.max((F.col("__record") > 0) | begins).alias("__begun"),
        F.max("__ends").alias("__ended"),
        *[F.first(f"`{c}`").alias(c) for c in kept],
    )


def _joined_parts(parts: DataFrame, kept: list[str]) -> DataFrame:
    """Records whose pieces lie in several blocks. There are two parts a block at most."""
    order = Window.partitionBy("__file").orderBy("__start", "__record")
    whole = F.sum(F.col("__begun").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    texts = F.array_sort(F.collect_list(F.struct("__start", "__text")))
    return (
        parts.withColumn("__whole", whole)
        .groupBy("__file", "__whole")
        .agg(
            F.array_join(F.transform(texts, lambda x: x["__text"]), "}").alias("__text"),
            F.min("__start").alias("__start"),
            F.min_by("__at", "__start").alias("__at"),
            F.min_by("__record", "__start").alias("__record"),
            F.max("__ended").alias("__ended"),
            *[F.first(f"`{c}`").alias(c) for c in kept],
        )
    )


def _records(parts: DataFrame, kept: list[str]) -> DataFrame:
    """``__json`` of each record, without what stands before it; the list's end is no record."""
    text = F.col("__text")
    first = (F.col("__start") == 0) & (F.col("__record") == 0)
    found = F.regexp_extract(text, FIRST, 1)
    found = F.when(first, found).otherwise(F.regexp_extract(text, NEXT, 1))
    wrong = F.raise_error(F.concat(F.lit("no list of JSON objects: "), F.col("__file"), F.lit(" near "), F.left(text, F.lit(80))))
    record = F.when(F.col("__ended") & (found != ""), F.concat(found, F.lit("}"))).when(
        F.col("__ended") | ~text.rlike(LAST), wrong.cast("string")
    )
    place = F.concat("__file", F.lit("#"), F.lpad(F.col("__start").cast("string"), 20, "0"))
    named = parts.select(record.alias("__json"), place.alias("__place"), "__at", *[F.col(f"`{c}`") for c in kept])
    return named.where("__json is not null")


def read_records(spark: SparkSession, path, schema, base_path: str | None) -> DataFrame | None:
    """The objects of all lists as columns, with a position: file and block, then order in the block; None if
    a file begins with something else, as one that is a single object does.

    Records are written to the shared folder one by one, next to their positions, and read from there: that
    is the reading which finds the columns where no ``schema`` names them. A file that is cut off, or
    holds anything but one list of objects, is an error.
    """
    pieces = pieces_of(spark, path, base_path)
    kept = [c for c in pieces.columns if not c.startswith("__")]
    states = stage(block_states(pieces), "json-blocks")
    if states.where("not coalesce(list, false)").limit(1).count():
        return None
    broken = states.where("not whole").select("__file").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0][0]} does not end where its list does")
    parts = stage(parts_of(pieces, states, kept), "json-parts")
    whole = F.col("__begun") & F.col("__ended")
    records = _records(parts.where(whole), kept).unionByName(_records(_joined_parts(parts.where(~whole), kept), kept))
    facts = F.to_json(F.struct("__place", "__at", *[F.col(f"`{c}`") for c in kept]))
    line = F.concat(F.lit('{"facts":'), facts, F.lit(',"record":'), F.col("__json"), F.lit("}"))
    folder = new_folder(spark, "json-records")
    records.select(line).write.option("lineSep", RECORD_END).text(folder)
    named = T.StructType([T.StructField("__place", T.StringType()), T.StructField("__at", T.LongType())])
    for c in kept:
        named = named.add(pieces.schema[c])
    reader = spark.read.options(mode="FAILFAST", lineSep=RECORD_END, encoding="UTF-8")
    if schema:
        declared = spark.createDataFrame([], schema).schema
    else:
        found = {f.name: f.dataType for f in reader.json(folder).schema}
        declared = found.get("record", T.StructType())
    both = T.StructType([T.StructField("facts", named), T.StructField("record", declared)])
    rows = reader.schema(both).json(folder)
    return rows.select(
        *[F.col(f"record.`{f.name}`") for f in declared if f.name not in kept],
        *[F.col(f"facts.`{c}`") for c in kept],
        F.lit(0).alias(SRC),
        F.col("facts.__place").alias(FILE),
        F.col("facts.__at").alias(ROW),
    )
