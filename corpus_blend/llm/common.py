"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_blend.staging import new_folder, stage

__all__ = ["id_and_text", "new_folder", "open_input", "read_table", "stage", "text_slices", "write_file"]

#: What counts as white space in words of all operators here: space, tab, line feed, VT, FF, CR.
BLANK = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator needs, under fixed names, so that no other column can clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def text_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 8 << 20):
    """Cut a batch into slices of about ``most_bytes`` of text (one row at least), so that what a
    task derives from a slice stays small however long the texts are."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _filesystem(uri: str):
    """The file system and the path in it; paths without a scheme are local ones."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def write_file(uri: str):
    """A binary stream that becomes the file ``uri`` when it is closed without an error.

    It is written under a hidden name of its own and moved at the end: a task that runs twice, or
    dies half-way, leaves one whole file or none.
    """
    system, path = _filesystem(uri)
    folder, name = posixpath.split(path)
    system.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(hidden) as out:
            yield out
        system.move(hidden, path)
    except BaseException:
        if system.get_file_info(hidden).type != pafs.FileType.NotFound:
            system.delete_file(hidden)
        raise


def open_input(uri: str):
    """A file that can be read at any place."""
    system, path = _filesystem(uri)
    return system.open_input_file(path)
