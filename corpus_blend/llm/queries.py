"""One registered query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_blend.llm import byte_pairs, embedding_dedup, exact_dedup, html_text, lexical_search, line_dedup, packing
from corpus_blend.llm import sentence_pieces, simhash, simple8b, toxicity, warc, whitening
from corpus_blend.llm.common import new_folder, read_table


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """A tokenizer's file as text, which goes to the tasks with their function."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", predicted)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    docs = docs.withColumn("n_lines", F.size(F.split("text", "\n")))
    found = line_dedup.line_dedup(docs, removed_col="n_removed")
    return found.select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), "n_removed", F.sha2("text", 256).alias("text_sha256")
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_dedup(read_table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_dedup(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    files = simple8b.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_json(), end_id=1, folder=folder)
    found = simple8b.read_tokens(spark, folder, files)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_json(), end_id=2)
    return found.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("example_tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    threads = max(2, int(spark.conf.get("spark.task.cpus", "1")))
    encoded = sentence_pieces.encode(read_table(spark, sf_dir, "documents"), model, threads=threads, verify=True)
    decoded = sentence_pieces.decode(encoded, model, threads)
    return decoded.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(read_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), digest=True)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256")
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return warc.read_warc(spark, folder).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokenizer_json("byte_bpe_50k.json")
    found = byte_pairs.decode(byte_pairs.encode(read_table(spark, sf_dir, "documents"), spec), spec)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "component",
        "n",
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(read_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, read_table(spark, sf_dir, "benchmark"), top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash": op4_simhash,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_html_text": op8_html_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}
