"""Standardizing a folder of arriving files, for sources too large or too live to load at once.

Standardizing is per row, so the batch operators run on a stream unchanged. Each
run takes the files that are new since the last one, in bounded batches, and
appends them to a Parquet folder exactly once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpus_blend.operators.standardize import to_target
from corpus_blend.plans.spec import SourceSpec
from corpus_blend.sources.load import reader_for
from corpus_blend.staging import new_folder


def ingest(
    spark: SparkSession,
    spec: SourceSpec,
    target: str,
    folder: str,
    checkpoint: str | None = None,
    files_per_batch: int = 1_000,
    keep=(),
) -> str:
    """Append what is new under ``spec.local_path`` to ``folder`` and stop.

    A stream has no rows to probe, so the source's schema and format are needed.
    Keep ``checkpoint`` to go on from there in the next run.
    """
    if not (spec.schema and spec.format):
        raise ValueError("a streamed source needs its schema and its format")
    kind = reader_for(spec.local_path, spec.reader)
    stream = spark.readStream.schema(spec.schema).option("maxFilesPerTrigger", files_per_batch)
    if kind == "csv":
        # cells go by name as in load_file, and a row that breaks off is an error
        stream = stream.options(header=True, escape='"', multiLine=spec.multi_line, mode="FAILFAST", enforceSchema=False)
    elif kind in ("json", "jsonl"):
        stream = stream.option("multiLine", kind == "json").option("mode", "FAILFAST")
    rows = stream.format("json" if kind == "jsonl" else kind).load(spec.local_path)
    shaped = to_target(
        rows,
        spec.format,
        target,
        spec.label,
        spec.split,
        spec.columns,
        keep=keep,
        json_content=spec.json_content,
        case_insensitive=spec.case_insensitive,
    )
    query = (
        shaped.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or new_folder(spark, "stream"))
        .trigger(availableNow=True)
        .start(folder)
    )
    query.awaitTermination()
    return folder
