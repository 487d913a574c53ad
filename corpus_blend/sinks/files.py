"""Writing a merged frame: files per split and format, a catalog table, and the card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_blend.functions.keys import POSITION
from corpus_blend.operators.position import with_position
from corpus_blend.operators.select import peek
from corpus_blend.plans.spec import SAVE_FORMATS
from corpus_blend.sources.load import escaped
from corpus_blend.staging import hadoop_path

SPLIT = "split"
CARD = "README.md"


def csv_columns(df: DataFrame) -> DataFrame:
    """CSV has no lists: they are written as JSON text."""
    nested = {
        f.name: F.to_json(F.col(f.name), {"ignoreNullFields": "false"})
        for f in df.schema
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    }
    return df.withColumns(nested) if nested else df


def save(df: DataFrame, path: str, formats: Sequence[str], partition: str | None = SPLIT) -> dict:
    """Write one folder per format, one subfolder per split; returns the folders.

    Rows keep their order inside a task. All splits are written in one pass.
    """
    wrong = [f for f in formats if f not in SAVE_FORMATS]
    if wrong:
        raise ValueError(f"unknown save formats {wrong} (use {', '.join(SAVE_FORMATS)})")
    folders = {}
    for kind in dict.fromkeys(formats):
        rows = csv_columns(df) if kind == "csv" else df
        writer = rows.write.mode("overwrite")
        if partition and partition in df.columns:
            writer = writer.partitionBy(partition)
        folder = f"{path.rstrip('/')}/{kind}"
        if kind == "jsonl":
            writer.option("ignoreNullFields", False).json(folder)
        elif kind == "csv":
            writer.options(header=True, escape='"').csv(folder)
        else:
            writer.parquet(folder)
        folders[kind] = folder
    return folders


def saved_files(spark: SparkSession, folders: dict[str, str]) -> dict[str, dict[str, str]]:
    """Where each split lies, by format."""
    found: dict[str, dict[str, str]] = {}
    for kind, folder in folders.items():
        system, path = hadoop_path(spark, folder)
        names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
        splits = {n.partition("=")[2]: f"{folder}/{n}" for n in sorted(names) if n.startswith(f"{SPLIT}=")}
        found[kind] = splits or {"all": folder}
    return found


def write_rows(df: DataFrame, folder: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
    return folder


def check_save_path(spark: SparkSession, spec) -> None:
    """Refuse to write over a source, which overwriting would delete before it is read."""
    if not spec.output.save_path:
        return
    target = str(hadoop_path(spark, spec.output.save_path)[1].toUri()).rstrip("/") + "/"
    for source in spec.sources:
        if source.local_path:
            read = str(hadoop_path(spark, source.local_path)[1].toUri()).rstrip("/") + "/"
            if read.startswith(target):
                raise ValueError(f"save_path {spec.output.save_path} holds the source {source.local_path}")


def publish(df: DataFrame, table: str, partition: str | None = SPLIT) -> None:
    """Write the merged frame as a catalog table partitioned by split."""
    writer = df.write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.saveAsTable(table)


def preview(spark: SparkSession, folder: str, n: int = 50, split: str | None = "train") -> DataFrame:
    """The first n rows of a saved JSON Lines folder, from its first files only; of one split if the
    folder has it."""
    system, path = hadoop_path(spark, f"{folder.rstrip('/')}/{SPLIT}={split}")
    whole = folder if split is None or not system.exists(path) else f"{folder.rstrip('/')}/{SPLIT}={split}"
    names = spark.read.format("binaryFile").load(whole).select("path").orderBy("path")
    opened, lines = 1, []
    while True:
        files = [escaped(r["path"]) for r in names.limit(opened + 1).collect()]
        rows = with_position(spark.read.text(files[:opened]))
        lines = [r["value"] for r in peek(rows, n, POSITION).collect()]
        if len(lines) >= n or opened >= len(files):
            break
        opened *= 2
    listed = f"[{','.join(lines)}]"
    schema = spark.range(1).select(F.schema_of_json(F.lit(listed))).first()[0]
    return spark.createDataFrame([(listed,)], "rows string").select(
        F.inline(F.from_json("rows", schema))
    )


def _table(head: Sequence[str], rows: Sequence[Sequence]) -> list[str]:
    def line(cells):
        return "| " + " | ".join(f"{c:,}" if isinstance(c, int) else str(c) for c in cells) + " |"

    return [line(head), "|" + "---|" * len(head), *map(line, rows), ""]


def card_text(summary: dict) -> str:
    """The dataset card: sources, row counts step by step, splits and blank rows."""
    sources = [
        (
            f"`{s['source']}`",
            s["format"],
            s["rows"],
            s["rows_kept"],
            f"{s['quality']['empty_rate']:.1%}",
        )
        for s in summary["sources"]
    ]
    counters = ("rows_before_filters", "rows_after_filters", "duplicates_removed", "final_rows")
    steps = [(name, summary[name]) for name in counters]
    steps += [(f"split: {name}", n) for name, n in summary["splits"].items()]
    steps.append(("empty_rows", summary["quality"]["empty_rows"]))
    prompt = "A system prompt opens every chat." if summary["system_prompt_injected"] else ""
    lines = ["---", "tags:", "- merged", "---", ""]
    lines += [f"# {len(sources)} sources as {summary['target_format']}", ""]
    lines += [f"Combined by `{summary['mode']}`. {prompt}".strip(), ""]
    lines += _table(("source", "read as", "rows read", "rows kept", "blank"), sources)
    lines += _table(("rows", "count"), steps)
    return "\n".join(lines)


def write_card(spark: SparkSession, path: str, summary: dict) -> str:
    """Write the card as README.md in the save path, on whatever file system that is."""
    target = f"{path.rstrip('/')}/{CARD}"
    system, found = hadoop_path(spark, target)
    out = system.create(found, True)
    try:
        out.write(bytearray(card_text(summary).encode()))
    finally:
        out.close()
    return target
