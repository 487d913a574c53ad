"""Reading sources: CSV, JSON Lines, JSON documents, Parquet and catalog tables."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.keys import POSITION
from corpus_blend.operators.position import settled, with_position
from corpus_blend.operators.select import first_rows, sample_fraction
from corpus_blend.plans.spec import SourceSpec
from corpus_blend.sources import csv_records, json_records
from corpus_blend.staging import stage

# File kinds, and the CSV cells read as missing.
READERS = ("csv", "json", "jsonl", "parquet")
MISSING_CELLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def reader_for(path: str, reader: str | None = None) -> str:
    """The reader asked for, else the one of the path's ending."""
    kind = (reader or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in READERS:
        raise ValueError(f"unsupported file type .{kind} (use {', '.join(READERS)})")
    return kind


def load_file(
    spark: SparkSession,
    path: str | list[str],
    reader: str | None = None,
    schema: str | T.StructType | None = None,
    order_by=None,
    multi_line: bool = True,
    missing_cells: bool = True,
    base_path: str | None = None,
    settle: bool = True,
) -> DataFrame:
    """Files, a folder or a glob as a DataFrame with a position.

    CSV cells stay text, and files whose headers differ are matched by column name. Quoted line
    breaks are read as such, however a file is split; ``multi_line=False`` spares the pass that tells
    them apart, for files without such breaks. Only files whose header itself holds a line break are
    read by one task each. JSON files that are lists are split too, if any is long enough for that; a source
    with a file that is a single object is read one file per task. A broken JSON record, or a CSV row with more or fewer
    cells than its header, is an error, not a lost row.

    Rows of CSV and JSON have no number of their own, so without ``order_by`` they are written to
    the shared folder with their positions, once, unless ``settle`` is off: such positions only
    hold for one reading.
    """
    kind = reader_for(path if isinstance(path, str) else path[0], reader)
    source = spark.read
    if base_path:
        source = source.option("basePath", base_path)
    if kind == "csv":
        rows, is_settled = _csv(spark, path, schema, multi_line, base_path, settle)
        rows = _without_missing(rows, [c for c in rows.columns if c not in POSITION]) if missing_cells else rows
        if order_by:
            rows = with_position(rows.drop(*POSITION), order_by)
        return settled(rows, order_by) if settle and (order_by or not is_settled) else rows
    if kind == "json" and json_records.may_split(spark, path):
        rows = json_records.read_records(spark, path, schema, base_path)
        if rows is not None:
            return settled(with_position(rows.drop(*POSITION), order_by), order_by) if order_by else rows
    if schema:
        source = source.schema(schema)
    if kind != "parquet":
        source = source.option("mode", "FAILFAST").option("multiLine", kind == "json")
    rows = with_position(source.format("json" if kind == "jsonl" else kind).load(path), order_by)
    return settled(rows, order_by) if settle else rows


def _csv(spark: SparkSession, path, schema, multi_line: bool, base_path, write: bool) -> tuple[DataFrame, bool]:
    """CSV rows with a position, by many tasks a file, and whether that position is settled."""
    of_files = stage(csv_records.headers_of(csv_records.lines_of(spark, path, base_path)), "csv-headers")
    headers = of_files.groupBy("header").agg(F.min("__file").alias("file"), F.max("odd").alias("odd")).collect()
    if not headers or any(r["odd"] for r in headers):
        return _csv_by_file(spark, path, headers, of_files, schema, multi_line, base_path), False
    declared = spark.createDataFrame([], schema).schema if schema else None
    columns = {}
    for r in sorted(headers, key=lambda r: r["file"]):
        found = _csv_reader(spark, None, multi_line).csv(plain_path(r["file"])).schema
        if declared and [f.name.lower() for f in found] != [f.name.lower() for f in declared]:
            raise ValueError(f"the header of {r['file']} ({', '.join(found.names)}) is not the schema's")
        columns[r["header"]] = declared or found
    rows = csv_records.read_records(spark, path, columns, of_files, base_path, multi_line, write)
    return rows, write


def _csv_reader(spark: SparkSession, base_path, multi_line: bool):
    source = spark.read.option("basePath", base_path) if base_path else spark.read
    return source.options(header=True, multiLine=multi_line, escape='"', mode="FAILFAST", enforceSchema=False)


def _csv_by_file(spark: SparkSession, path, headers, of_files, schema, multi_line: bool, base_path) -> DataFrame:
    """Files whose first line is no whole header (or that have no line), each read by one task."""

    def read(files):
        source = _csv_reader(spark, base_path, multi_line)
        return with_position((source.schema(schema) if schema else source).csv(files))

    if len(headers) <= 1 or schema:
        return read(path)
    groups = of_files.groupBy("header").agg(F.collect_list("__file").alias("files")).collect()
    parts = [read([plain_path(f) for f in sorted(r["files"])]) for r in sorted(groups, key=lambda r: min(r["files"]))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def plain_path(uri: str) -> str:
    """A file's URI as Spark's metadata has it, as a path that reads that file."""
    return escaped(unquote(uri))


def escaped(path: str) -> str:
    """A path in which no character makes a pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def _without_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = {
        c: F.when(~F.col(f"`{c}`").isin(*MISSING_CELLS), F.col(f"`{c}`"))
        for c in columns
        if isinstance(df.schema[c].dataType, T.StringType)
    }
    return df.withColumns(cells) if cells else df


def first_file_rows(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The first rows of files that are read in order of their names: only the first files
    are opened, twice as many until they hold enough.

    Columns are those of all files, or the declared ``schema``; without one JSON and CSV files
    are all looked at once to find them.
    """
    path, n = spec.local_path, spec.max_samples
    kind = reader_for(path, spec.reader)
    names = spark.read.format("binaryFile").load(path).select("path")
    schema = spec.schema
    if not schema:
        schema = read_source(spark, spec, settle=False).drop(*POSITION).schema
    folder = not any(c in path for c in "*?[{")
    opened = 1
    while True:
        # as many names as files are opened, never the whole list
        files = [escaped(r["path"]) for r in names.orderBy("path").limit(opened + 1).collect()]
        last = len(files) <= opened
        rows = load_file(
            spark,
            files[:opened],
            kind,
            schema if kind != "csv" else spec.schema,
            multi_line=spec.multi_line,
            base_path=path if folder and files and not files[0].endswith(escaped(path)) else None,
            settle=False,
        )
        if kind == "csv" and not spec.schema:
            rows = rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns))
        if last or rows.count() >= n:
            return first_rows(settled(rows), n)
        opened *= 2


def load_table(
    spark: SparkSession,
    name: str,
    split: str | None = None,
    config: str | None = None,
    order_by=None,
) -> DataFrame:
    """A catalog table with a position; ``split`` and ``config`` select rows where the table
    has a column of that name."""
    table = spark.table(name)
    rows = settled(with_position(table, order_by), order_by)
    for column, value in (("split", split), ("config", config)):
        if value is not None and column in table.columns:
            rows = rows.where(F.col(column) == value).drop(column)
    return rows


def read_source(spark: SparkSession, spec: SourceSpec, settle: bool = True) -> DataFrame:
    """All rows of a source, before its cap and sample."""
    if spec.local_path:
        return load_file(
            spark, spec.local_path, spec.reader, spec.schema, spec.order_by, spec.multi_line, settle=settle
        )
    return load_table(spark, spec.repo_id, spec.split, spec.config, spec.order_by)


def load_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A source with its row cap, then its random share, applied.

    A scan is lazy, so ``streaming`` makes little difference here: a cap opens
    no more files than it needs, and without a cap nothing is held in memory.
    """
    if spec.max_samples and spec.local_path and not spec.order_by:
        rows = first_file_rows(spark, spec)
    else:
        rows = first_rows(read_source(spark, spec), spec.max_samples)
    return sample_fraction(rows, spec.sample_fraction, spec.sample_seed)
