"""From raw documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; whoever runs them writes it and hands
what was written to the next. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_blend.llm import line_dedup, packing, simhash, toxicity
from corpus_blend.llm.common import read_table, stage
from corpus_blend.llm.queries import tokenizer_json


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on ``labels`` gives a score of 0.5 or more go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred before go; every document stays, empty if need be."""
    edited = line_dedup.line_dedup(docs)
    return edited.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints (four-word shingles) are linked at 4 or fewer
    differing bits, the document with the smallest id stays; see ``drop_near_duplicates``."""
    return simhash.drop_near_duplicates(docs, words=4, distance=4).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, in sequences of at most 4096."""
    found = packing.pack_documents(docs, tokenizer_json(), end_id=2)
    return found.withColumnsRenamed({"id": "doc_id", "example_tokens": "doc_tokens"}).drop("loss_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("packing", pack),
]
#: SQL expresses neither a trained classifier nor a tokenizer; the tests rebuild each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
