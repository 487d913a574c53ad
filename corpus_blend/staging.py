"""Tables written to the cluster's shared folder.

A written table ends a lineage for good: losing executors cannot change it, a
reader takes only the columns it needs, and counts come from file footers.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local run may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-blend-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    run = _run.get()
    return f"{shared_folder(spark)}/corpus_blend/{f'{run}/' if run else ''}{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def one_run(spark: SparkSession):
    """What is staged inside has a folder of its own, deleted at the end, whatever happens; and
    the session's number of shuffle partitions is as before."""
    name = "spark.sql.shuffle.partitions"
    partitions = spark.conf.get(name)
    run = f"run-{uuid.uuid4().hex}"
    token = _run.set(run)
    try:
        yield
    finally:
        _run.reset(token)
        spark.conf.set(name, partitions)
        delete(spark, f"{shared_folder(spark)}/corpus_blend/{run}")


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it is on, as Spark's own readers see them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(found)


def delete(spark: SparkSession, path: str) -> None:
    system, found = hadoop_path(spark, path)
    system.delete(found, True)
