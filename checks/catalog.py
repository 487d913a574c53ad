"""The registered queries: each runs operators of the package over the given tables."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_blend as cb
from checks import derived as d
from corpus_blend.functions.chat import row_hash, row_length
from corpus_blend.operators import report
from corpus_blend.plans.merge import Blend
from corpus_blend.plans.spec import MergeSpec, load_config
from corpus_blend.sinks.files import preview, publish, save
from corpus_blend.sources.load import load_file, load_source
from corpus_blend.staging import new_folder
from corpus_blend.streaming.ingest import ingest

TABLES = (
    "region nation customer supplier part orders lineitem "
    "events documents embeddings pages benchmark labels conversations"
).split()
PROMPT = "You are a helpful assistant."
SHARE = 0.3
HEAD = 100
WEIGHTS = (0.5, 0.3, 0.2)
BOUNDS = (4, 8192)


def _messages(df: DataFrame) -> DataFrame:
    rows = df.select("key", F.posexplode("messages").alias("idx", "m"))
    return rows.select("key", F.col("idx").cast("bigint"), "m.role", "m.content")


def _standard(source, columns: dict | None = None, fmt: str | None = None, **options):
    """A source through detection (or its given format) to its natural shape."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        found = cb.detect_format(rows.drop("key"), fmt)
        shaped = cb.standardize(rows, found, columns, keep=["key"], **options)
        if "messages" in shaped.columns:
            return _messages(shaped)
        return shaped.drop("_src", "_file", "_row")

    return run


def _converted(source, target: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        found = cb.detect_format(rows.drop("key"))
        shaped = cb.to_target(rows, found, target, keep=["key"])
        if target == "chatml":
            return _messages(shaped)
        return shaped.drop("_src", "_file", "_row", "source_dataset", "source_split")

    return run


def _renamed(question: str, answer: str):
    return lambda spark, sf_dir: d.renamed_qa(spark, sf_dir, question, answer)


def _dict_answer(spark, sf_dir):
    pairs = d.renamed_qa(spark, sf_dir, "question", "answer")
    return pairs.withColumn("answer", F.struct(F.col("answer").alias("text")))


def _map_answer(spark, sf_dir):
    """The key that holds the answer differs from row to row; its presence decides."""
    pairs = d.qa(spark, sf_dir)
    holder = F.when(F.col("turn") % 3 == 0, "text").when(F.col("turn") % 3 == 1, "content")
    held = F.create_map(F.lit("note"), F.lit("-"), F.coalesce(holder, F.lit("value")), "answer")
    return pairs.withColumn("answer", held).drop("conv_id", "turn")


def _struct_answer(spark, sf_dir):
    pairs = d.qa(spark, sf_dir)
    packed = F.struct(
        F.col("answer").alias("body"),
        F.col("turn").alias("turn"),
        (F.col("turn") % 2 == 0).alias("even"),
        F.lit(None).cast("string").alias("nothing"),
        F.array(F.col("turn"), F.col("conv_id")).alias("ids"),
    )
    return pairs.withColumn("answer", packed).drop("conv_id", "turn")


def _scalar_fields(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.col("n_chars").alias("instruction"),
        (F.col("doc_id") % 2 == 0).alias("input"),
        (F.col("n_chars") / 2).alias("output"),
    )
    return cb.with_position(docs, "key")


def _deep_json(spark, sf_dir):
    """Every text as JSON six levels deep; every third as a bare object, which is no text to unpack."""
    docs = d.text(spark, sf_dir)
    inner = F.to_json(F.array(F.struct(F.struct(F.array(F.struct(F.col("text").alias("value"))).alias("content")).alias("text"))))
    bare = F.to_json(F.struct(F.col("text").alias("b"), F.lit(2).alias("a")))
    return docs.withColumn("text", F.when(F.col("key") % 3 == 0, bare).otherwise(inner))


def _deeper_json(spark, sf_dir):
    """Every text as JSON forty-two levels deep."""
    docs = d.text(spark, sf_dir)
    inner = F.to_json(F.array(F.struct(F.col("text").alias("value"))))
    deep = F.concat(F.repeat(F.lit('[{"content":'), F.lit(20)), inner, F.repeat(F.lit("}]"), F.lit(20)))
    return docs.withColumn("text", deep)


def detect_empty_first(spark, sf_dir):
    """Chats of which all but the last few are empty still are chats."""
    rows = d.chatml(spark, sf_dir)
    late = F.col("key") >= rows.agg(F.max("key") - 2).scalar()
    rows = rows.withColumn("messages", F.when(late, F.col("messages")).otherwise(F.slice("messages", 1, 0)))
    found = report.inspect_source(rows.drop("key"), "chats")
    return _listed(found)


def _word_lists(spark, sf_dir):
    return d.text(spark, sf_dir).withColumn("text", F.split("text", " "))


def _chatml_sources(spark, sf_dir) -> list[DataFrame]:
    named = [("chats", d.chatml), ("tasks", d.alpaca), ("texts", d.text)]
    frames = []
    for label, source in named:
        rows = source(spark, sf_dir)
        found = cb.detect_format(rows.drop("key"))
        frames.append(cb.to_target(rows, found, "chatml", label, keep=["key"]))
    return frames


def _per_source(df: DataFrame, target: str = "chatml") -> DataFrame:
    return df.groupBy("source_dataset", "source_split").agg(
        F.count("*").alias("n_rows"), F.sum(row_length(target)).alias("n_chars")
    )


# --- reports before merging ---------------------------------------------------------


def inspect_sources(spark, sf_dir):
    rows = [report.inspect_source(d.table(spark, sf_dir, t), t) for t in TABLES]
    return _listed(reduce(DataFrame.unionByName, rows))


def _listed(inspected: DataFrame) -> DataFrame:
    return inspected.withColumn("columns", F.array_join("columns", ",")).drop("sample")


def inspect_profile(spark, sf_dir):
    """The inspect job with its profile, of a source named in a configuration."""
    d.text(spark, sf_dir).select("key", "text").createOrReplaceTempView("cb_profiled")
    spec = MergeSpec.from_dict({"datasets": [{"repo_id": "cb_profiled", "order_by": "key"}]})
    found = cb.inspect_sources(spark, spec, profile=True)
    return _listed(found).select("source", "format", "n_rows", "columns", "avg_length", "n_missing", "n_empty")


def inspect_layouts(spark, sf_dir):
    sources = {
        "alpaca": d.alpaca,
        "blocks": d.blocks,
        "chatml": d.chatml,
        "content": d.content,
        "fuzzy": _renamed("task_description", "model_answer"),
        "io": _renamed("input", "output"),
        "manual": _renamed("q_txt", "a_txt"),
        "preference": d.preference,
        "prompt": _renamed("prompt", "response"),
        "qa": _renamed("question", "answer"),
        "sharegpt": d.sharegpt,
        "text": d.text,
    }
    rows = [
        report.inspect_source(source(spark, sf_dir).drop("key"), label)
        for label, source in sources.items()
    ]
    return _listed(reduce(DataFrame.unionByName, rows))


def source_profile(spark, sf_dir):
    sources = {"chats": d.sharegpt, "empty": d.half_empty, "texts": d.text, "tasks": d.alpaca}
    rows = [
        report.profile_source(source(spark, sf_dir).drop("key"), label)
        for label, source in sources.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def source_roles(spark, sf_dir):
    return report.profile_roles(d.spellings(spark, sf_dir).drop("key"), "chats")


# --- combining -----------------------------------------------------------------------


def flagship(spark, sf_dir):
    """Merge chats, tasks and texts into chats, drop too short and too long rows and repeats,
    and count what each source gave."""
    merged = cb.concatenate(_chatml_sources(spark, sf_dir))
    kept = cb.filter_length(merged, "chatml", *BOUNDS)
    # with the length taken first, no text goes through the exchange
    measured = kept.withColumn("length", row_length("chatml"))
    return cb.dedupe(measured, "chatml").groupBy("source_dataset", "source_split").agg(
        F.count("*").alias("n_rows"), F.sum("length").alias("n_chars")
    )


def concat_provenance(spark, sf_dir):
    return _per_source(cb.concatenate(_chatml_sources(spark, sf_dir)))


def align_missing(spark, sf_dir):
    """Sources in different shapes: the columns one lacks become null."""
    chats = cb.standardize(d.chatml(spark, sf_dir), "chatml", keep=["key"])
    texts = cb.standardize(d.text(spark, sf_dir), "text", keep=["key"])
    pairs = cb.standardize(d.preference(spark, sf_dir), "preference", keep=["key"])
    merged = cb.concatenate([chats, texts, pairs])
    return merged.groupBy(F.col("_src").cast("bigint").alias("source")).agg(
        F.count("*").alias("n_rows"),
        F.count("messages").alias("n_messages"),
        F.count("text").alias("n_text"),
        F.count("chosen").alias("n_chosen"),
    )


def _mixed(weights, stop):
    def run(spark, sf_dir):
        said = F.array_join(F.transform("messages", lambda m: m.getField("content")), "|")
        sources = [(d.text, F.col("text")), (d.chatml, said), (d.qa, F.col("question"))]
        frames = [
            s(spark, sf_dir).select("key", c.alias("content"), "_src", "_file", "_row") for s, c in sources
        ]
        mixed = cb.interleave(frames, weights, 42, stop)
        return mixed.select(
            F.col("_row").alias("draw"),
            F.col("_from").cast("bigint").alias("source"),
            F.col("_index").alias("row_index"),
            "key",
            "content",
        )

    return run


# --- cleaning -------------------------------------------------------------------------


def system_prompt(spark, sf_dir):
    rows = cb.to_target(d.chatml(spark, sf_dir), "chatml", "chatml", keep=["key"])
    return _messages(cb.inject_system_prompt(rows, PROMPT))


def _filtered(source, fmt, target, low, high):
    def run(spark, sf_dir):
        rows = cb.to_target(source(spark, sf_dir), fmt, target, keep=["key"])
        kept = cb.filter_length(rows, target, low, high)
        return kept.select("key", row_length(target).alias("length"))

    return run


def _deduped(source, fmt, target, **options):
    def run(spark, sf_dir):
        rows = cb.to_target(source(spark, sf_dir), fmt, target, keep=["key"])
        kept = cb.dedupe(rows, target, **options)
        return kept.select("key", F.col("_src").cast("bigint").alias("part"))

    return run


def dedupe_examples(spark, sf_dir):
    rows = cb.to_target(d.text(spark, sf_dir), "text", "text", "texts")
    return cb.duplicates(rows, "text").select(
        F.col("_row").alias("key"), F.col("source_dataset").alias("source"), "preview"
    )


def dedupe_examples_chat(spark, sf_dir):
    rows = cb.to_target(d.twice(spark, sf_dir), "chatml", "chatml", "chats")
    return cb.duplicates(rows, "chatml").select(
        F.col("_row").alias("key"), F.col("source_dataset").alias("source"), "preview"
    )


# --- choosing and ordering ----------------------------------------------------------


def head_cap(spark, sf_dir):
    return cb.first_rows(d.text(spark, sf_dir), HEAD).select("key", "text")


def sample_fraction(spark, sf_dir):
    return cb.sample_fraction(d.text(spark, sf_dir), SHARE, key="key").select("key", "text")


def shuffle_order(spark, sf_dir):
    """Position of every row in the shuffled order, numbered task by task."""
    mixed = cb.shuffle(d.text(spark, sf_dir).select("key", "text"), 42, "key")
    numbered = mixed.withColumn("_at", F.monotonically_increasing_id())
    placed = cb.dense_index(numbered, "_at")
    return placed.select("key", F.col("_index").alias("position"), F.length("text").cast("bigint").alias("length"))


def train_test_split(spark, sf_dir):
    return cb.split_train_test(d.text(spark, sf_dir), 0.1, 42, "key").select("key", "split")


def train_test_count(spark, sf_dir):
    return cb.split_train_test(d.qa(spark, sf_dir), 25, 7, "key").select("key", "split")


def row_numbers(spark, sf_dir):
    """Rows of each language numbered in order, without one task per language."""
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "lang")
    numbered = cb.dense_index(docs, ["lang", "doc_id"], within="lang")
    return numbered.select("doc_id", "lang", F.col("_index").alias("position"))


def peek_pages(spark, sf_dir):
    return report.peek(d.content(spark, sf_dir), 5, "key").select("key", "content")


# --- reports after merging -----------------------------------------------------------


def _reported(spark, sf_dir) -> DataFrame:
    frames = _chatml_sources(spark, sf_dir)
    empty = cb.to_target(d.half_empty(spark, sf_dir), "qa", "chatml", "answers", keep=["key"])
    return cb.concatenate([*frames, empty])


def quality_by_source(spark, sf_dir):
    return report.quality(_reported(spark, sf_dir), "chatml", "source_dataset")


def quality_overall(spark, sf_dir):
    merged = _reported(spark, sf_dir)
    return report.quality(merged, "chatml", threshold=report.MERGED_EMPTY_RATE)


def quality_preference(spark, sf_dir):
    rows = cb.to_target(d.preference(spark, sf_dir), "preference", "preference", "pairs")
    return report.quality(rows, "preference", "source_dataset")


def source_counts(spark, sf_dir):
    return report.source_counts(_reported(spark, sf_dir))


def source_report(spark, sf_dir):
    found = report.source_report(_reported(spark, sf_dir), "chatml", ["chatml", "alpaca", "text", "qa"])
    return found.withColumn("source", F.col("source").cast("bigint"))


def source_report_twice(spark, sf_dir):
    """One table listed twice is two sources with one label."""
    even = F.col("key") % 2 == 0
    frames = [
        cb.to_target(d.text(spark, sf_dir).where(part), "text", "text", "texts", split)
        for part, split in ((even, "train"), (~even, "test"))
    ]
    found = report.source_report(cb.concatenate(frames), "text", ["text", "text"])
    return found.withColumn("source", F.col("source").cast("bigint"))


def role_counts(spark, sf_dir):
    return report.role_counts(_reported(spark, sf_dir))


def length_histogram(spark, sf_dir):
    rows = cb.to_target(d.text(spark, sf_dir), "text", "text")
    return _plain_bins(report.length_histogram(rows, "text"))


def _plain_bins(bins: DataFrame) -> DataFrame:
    return bins.withColumn("bin", F.col("bin").cast("bigint"))


# --- the whole job --------------------------------------------------------------------


def _views(spark, sf_dir) -> dict[str, str]:
    """The derived sources as tables a configuration can name."""
    sources = {
        "cb_chats": d.chatml(spark, sf_dir),
        "cb_tasks": d.alpaca(spark, sf_dir),
        "cb_texts": d.text(spark, sf_dir),
        "cb_answers": d.half_empty(spark, sf_dir),
    }
    for name, rows in sources.items():
        rows.drop("_src", "_file", "_row").createOrReplaceTempView(name)
    return list(sources)


def _spec(spark, sf_dir, **output) -> MergeSpec:
    names = _views(spark, sf_dir)
    settings = {"min_length": BOUNDS[0], "max_length": BOUNDS[1], "train_test_split": 0.1}
    return MergeSpec.from_dict(
        {
            "datasets": [{"repo_id": n, "order_by": "key"} for n in names],
            "output": {**settings, "system_prompt": PROMPT, **output},
        }
    )


def _in_order(final: DataFrame, target: str) -> DataFrame:
    """Every final row with its place in its split and a hash of its content."""
    rows = final.select(
        "source_dataset",
        "split",
        row_hash(target).alias("content"),
        F.monotonically_increasing_id().alias("_at"),
    )
    placed = cb.dense_index(rows, ["split", "_at"], within="split")
    return placed.select("source_dataset", "split", "content", F.col("_index").alias("position"))


def _merged(**output):
    def run(spark, sf_dir):
        final = Blend(spark, _spec(spark, sf_dir, **output)).final()
        return _in_order(final, output.get("target_format", "chatml"))

    return run


def _json_lines(spark, sf_dir, table: str, key: str) -> str:
    """The texts of a table as JSON Lines in order of their key, in several files."""
    rows = d.table(spark, sf_dir, table).select("text", key)
    ordered = rows.repartitionByRange(5, key).sortWithinPartitions(key).select("text")
    return save(ordered, new_folder(spark, "lines"), ["jsonl"], None)["jsonl"]


def _plain(datasets: list[dict], **output) -> MergeSpec:
    settings = {"target_format": "text", "dedupe": False, "shuffle": False, **output}
    return MergeSpec.from_dict({"datasets": datasets, "output": settings})


def merge_jsonl_interleave(spark, sf_dir):
    """Two folders of JSON Lines without a column to order by, mixed in turn."""
    paths = [_json_lines(spark, sf_dir, "documents", "doc_id"), _json_lines(spark, sf_dir, "benchmark", "item_id")]
    spec = _plain([{"local_path": p, "reader": "jsonl"} for p in paths], mode="interleave")
    placed = _in_order(Blend(spark, spec).final(), "text")
    source = F.when(F.col("source_dataset") == paths[0], "documents").otherwise("benchmark")
    return placed.withColumn("source_dataset", source)


def merge_jsonl_capped_sampled(spark, sf_dir):
    """A cap, then a share, of JSON Lines without a column to order by: exact sizes."""
    path = _json_lines(spark, sf_dir, "documents", "doc_id")
    spec = _plain([{"local_path": path, "reader": "jsonl", "max_samples": 3 * HEAD, "sample_fraction": SHARE}])
    blend = Blend(spark, spec)
    final = blend.final()
    first = d.table(spark, sf_dir, "documents").orderBy("doc_id").limit(3 * HEAD).select("text").distinct()
    known = final.join(first, "text", "left_semi").agg(F.count("*").alias("n_known"))
    counted = final.agg(F.count("*").alias("n_rows"))
    planned = F.lit(blend.n_final).cast("bigint").alias("n_planned")
    return counted.select("n_rows", planned, known.scalar().alias("n_known"))


def merge_view_without_order(spark, sf_dir):
    """A view whose rows come in any order, mixed by weight and deduplicated: all texts are there."""
    d.table(spark, sf_dir, "documents").select("text").repartition(7).createOrReplaceTempView("cb_any_order")
    d.table(spark, sf_dir, "benchmark").select("text").repartition(3).createOrReplaceTempView("cb_any_items")
    spec = _plain(
        [{"repo_id": "cb_any_order"}, {"repo_id": "cb_any_items"}],
        mode="interleave", probabilities=[5, 3], dedupe=True, shuffle=True,
    )
    return Blend(spark, spec).final().select(F.sha2("text", 256).alias("content"))


def merge_many_roles(spark, sf_dir):
    """More roles than a summary would list."""
    docs = d.table(spark, sf_dir, "documents")
    turn = lambda name: F.struct(F.concat(F.lit(name), "doc_id").alias("role"), F.col("text").alias("content"))
    docs.select("doc_id", F.array(turn("a"), turn("b")).alias("messages")).createOrReplaceTempView("cb_roles")
    spec = MergeSpec.from_dict({"datasets": [{"repo_id": "cb_roles", "order_by": "doc_id"}], "output": {"dedupe": False}})
    return Blend(spark, spec).statistics()["role_counts"]


def merge_role_top(spark, sf_dir):
    """The roles that the summary of the same merge lists: the most frequent ones."""
    merge_many_roles(spark, sf_dir)
    spec = MergeSpec.from_dict(
        {"datasets": [{"repo_id": "cb_roles", "order_by": "doc_id"}], "output": {"dedupe": False, "save_path": new_folder(spark, "roles")}}
    )
    listed = cb.run_merge(spark, spec)["role_counts"]
    return spark.createDataFrame(list(listed.items()), "role string, n_messages bigint")


def refusals(spark, sf_dir):
    """Sources that are refused, why, and how many rows each would have brought."""
    docs = d.table(spark, sf_dir, "documents")
    numbers = docs.select(F.col("lang").alias("foo"), F.col("n_chars").alias("bar"))
    cases = [
        ("texts", d.text(spark, sf_dir), lambda rows: cb.to_target(rows, "text", "preference", "texts")),
        ("chats", d.chatml(spark, sf_dir), lambda rows: cb.to_target(rows, "chatml", "preference", "chats")),
        ("numbers", numbers, lambda rows: cb.to_target(rows, cb.detect_format(rows), "text", "numbers")),
        ("sheet", docs, lambda rows: load_file(spark, "documents.xlsx")),
    ]
    found = []
    for name, rows, load in cases:
        try:
            load(rows)
            message = None
        except ValueError as error:
            message = str(error)
        counted = rows.agg(F.count("*").alias("n_rows"))
        found.append(counted.select(F.lit(name).alias("source"), F.lit(message).cast("string").alias("message"), "n_rows"))
    return reduce(DataFrame.unionByName, found)


def card_counts(spark, sf_dir):
    """The row counts that stand in the card of a saved merge."""
    spec = _spec(spark, sf_dir, save_path=new_folder(spark, "card"), save_formats=["parquet"])
    lines = spark.read.text(cb.run_merge(spark, spec)["dataset_card"])
    cells = r"^\| ([a-z_: ]+) \| ([0-9,]+) \|$"
    number = F.replace(F.regexp_extract("value", cells, 2), F.lit(","), F.lit("")).cast("bigint")
    return lines.where(F.col("value").rlike(cells)).select(F.regexp_extract("value", cells, 1).alias("name"), number.alias("n"))


def merge_from_file(spark, sf_dir):
    """The same merge as merge_counters, its configuration written to a file and read from there."""
    names = _views(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "config.json")
        output = {"min_length": BOUNDS[0], "max_length": BOUNDS[1], "train_test_split": 0.1, "system_prompt": PROMPT}
        with open(path, "w", encoding="utf-8") as file:
            json.dump({"datasets": [{"repo_id": n, "order_by": "key"} for n in names], "output": output}, file)
        spec = load_config(path)
    return _counters(Blend(spark, spec))


def merge_counters(spark, sf_dir):
    return _counters(Blend(spark, _spec(spark, sf_dir)))


def _counters(blend: Blend) -> DataFrame:
    counts = {**blend.counters(), **{f"{k}_rows": v for k, v in blend.splits().items()}}
    blank = report.quality_of(blend.survivors, F.col("_blank"))
    return blank.select(
        *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()], "empty_rows"
    )


def merge_lengths(spark, sf_dir):
    return _plain_bins(Blend(spark, _spec(spark, sf_dir)).statistics()["lengths"])


def merge_roles(spark, sf_dir):
    return Blend(spark, _spec(spark, sf_dir)).statistics()["role_counts"]


# --- files -----------------------------------------------------------------------------


def _documents(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


def _read_back(kind: str, **options):
    def run(spark, sf_dir):
        written = save(_documents(spark, sf_dir), new_folder(spark, "files"), [kind], None)[kind]
        rows = load_file(spark, written, kind, **options)
        return rows.select(
            F.col("doc_id").cast("bigint"), "text", "lang", F.col("n_chars").cast("bigint")
        )

    return run


def read_json(spark, sf_dir):
    """JSON documents, each a list of up to a hundred records in a file of its own."""
    folder = new_folder(spark, "files")
    record = F.struct("doc_id", "text", "lang", "n_chars")
    lists = _documents(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 100).alias("g"))
    documents = lists.agg(F.to_json(F.collect_list(record)).alias("value")).select("value")
    documents.write.option("maxRecordsPerFile", 1).text(folder)
    rows = load_file(spark, folder, "json")
    return rows.select("doc_id", "text", "lang", "n_chars")


def read_json_split(spark, sf_dir):
    """Lists of a thousand records, each read by many tasks: records lie across the ends of blocks."""
    folder = new_folder(spark, "files")
    record = F.struct("doc_id", "text", "lang", "n_chars")
    lists = _documents(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 1000).alias("g"))
    documents = lists.agg(F.to_json(F.collect_list(record)).alias("value")).select("value")
    documents.write.option("maxRecordsPerFile", 1).text(folder)
    sizes = {"spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "16k"}
    before = {name: spark.conf.get(name) for name in sizes}
    try:
        for name, size in sizes.items():
            spark.conf.set(name, size)
        rows = load_file(spark, folder, "json")
    finally:
        for name, size in before.items():
            spark.conf.set(name, size)
    return rows.select("doc_id", "text", "lang", "n_chars")


def read_parquet_order(spark, sf_dir):
    """File position stands in for an order column."""
    rows = load_file(spark, f"{sf_dir}/documents.parquet")
    placed = cb.dense_index(rows.select("doc_id", "text", "_src", "_file", "_row"))
    return placed.select("doc_id", "text", F.col("_index").alias("position"))


def read_csv_two_headers(spark, sf_dir):
    """A folder whose name holds a space and a percent sign, with files whose columns are in a
    different order: cells go by name."""
    folder = f"{new_folder(spark, 'two headers 100%')}"
    docs = _documents(spark, sf_dir)
    halves = (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").select("n_chars", "lang", "text", "doc_id"))
    for half in halves:
        half.write.mode("append").options(header=True, escape='"').csv(folder)
    rows = load_file(spark, folder, "csv")
    return rows.select(F.col("doc_id").cast("bigint"), "text", "lang", F.col("n_chars").cast("bigint"))


def read_capped(spark, sf_dir):
    """The first rows of many files; only the first files are opened."""
    ordered = _documents(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    folder = save(ordered, new_folder(spark, "files"), ["jsonl"], None)["jsonl"]
    entry = {"local_path": folder, "reader": "jsonl", "streaming": True, "max_samples": HEAD}
    spec = MergeSpec.from_dict({"datasets": [entry]}).sources[0]
    return load_source(spark, spec).select("doc_id", "text")


def read_table(spark, sf_dir):
    """A catalog table, its split chosen by a column, capped and sampled as configured."""
    halves = F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split")
    _documents(spark, sf_dir).select("*", halves).createOrReplaceTempView("cb_halves")
    spec = MergeSpec.from_dict(
        {"datasets": [{"repo_id": "cb_halves", "order_by": "doc_id", "sample_fraction": SHARE}]}
    ).sources[0]
    return load_source(spark, spec).select("doc_id", "text")


def write_round_trip(spark, sf_dir):
    """Chats with a split, written in every format in one go and read back from each."""
    rows = cb.to_target(d.chatml(spark, sf_dir), "chatml", "chatml", "chats", keep=["key"])
    split = cb.split_train_test(rows, 0.2, 42, "key").drop("_src", "_file", "_row")
    written = save(split, new_folder(spark, "saved"), ["jsonl", "csv", "parquet"])
    frames = []
    for kind, folder in written.items():
        back = load_file(spark, folder, kind)
        if kind == "csv":
            messages = F.from_json("messages", "array<struct<role:string,content:string>>")
            back = back.withColumn("messages", messages)
        frames.append(
            back.select(
                F.lit(kind).alias("kind"),
                F.col("key").cast("bigint"),
                "split",
                F.size("messages").cast("bigint").alias("n_messages"),
                row_length("chatml").alias("length"),
                row_hash("chatml").alias("content"),
                "source_dataset",
            )
        )
    return reduce(DataFrame.unionByName, frames)


def publish_round_trip(spark, sf_dir):
    """Texts published as a catalog table and read back from it as a source."""
    rows = cb.to_target(d.text(spark, sf_dir), "text", "text", "texts", keep=["key"])
    split = cb.split_train_test(rows, 0.1, 42, "key").select("key", "text", "split")
    name = f"cb_published_{uuid.uuid4().hex}"  # a table of an earlier session would be in the way
    publish(split, name)
    back = load_source(spark, MergeSpec.from_dict({"datasets": [{"repo_id": name, "split": "test"}]}).sources[0])
    return back.select("key", "text")


def saved_preview(spark, sf_dir):
    """The first rows of a saved folder whose files are in order."""
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    folder = save(ordered, new_folder(spark, "saved"), ["jsonl"])["jsonl"]
    return preview(spark, folder)


def stream_ingest(spark, sf_dir):
    """The same texts standardized as a stream of files."""
    schema = "doc_id bigint, text string"
    entry = {
        "local_path": f"{sf_dir}/documents.parque[t]",
        "format": "text",
        "schema": schema,
        "reader": "parquet",
    }
    spec = MergeSpec.from_dict({"datasets": [entry]}).sources[0]
    folder = ingest(spark, spec, "chatml", new_folder(spark, "streamed"), keep=["doc_id"])
    rows = spark.read.parquet(folder)
    return _messages(rows.withColumnRenamed("doc_id", "key"))


def queries() -> dict:
    return {
        "flagship_merge": flagship,
        "inspect_sources": inspect_sources,
        "inspect_layouts": inspect_layouts,
        "inspect_profile": inspect_profile,
        "detect_empty_first": detect_empty_first,
        "source_profile": source_profile,
        "source_roles": source_roles,
        "peek_pages": peek_pages,
        # layouts
        "std_alpaca": _standard(d.alpaca),
        "std_prompt_response": _standard(_renamed("prompt", "response")),
        "std_prompt_completion": _standard(_renamed("prompt", "completion")),
        "std_qa": _standard(_renamed("question", "answer")),
        "std_input_output": _standard(_renamed("input", "output")),
        "std_sharegpt": _standard(d.sharegpt),
        "std_chatml": _standard(d.chatml),
        "std_roles": _standard(d.spellings),
        "std_text": _standard(d.text),
        "std_content": _standard(d.content),
        "std_preference": _standard(d.preference),
        "std_fuzzy": _standard(_renamed("task_description", "model_answer")),
        "std_manual": _standard(
            _renamed("q_txt", "a_txt"),
            {"prompt_key": "q_txt", "completion_key": "a_txt"},
            "prompt_completion",
        ),
        # coercion
        "coerce_blocks": _standard(d.blocks),
        "coerce_content_blocks": _standard(d.content_blocks),
        "coerce_typed_blocks": _standard(d.typed_blocks),
        "coerce_dict_value": _standard(_dict_answer),
        "coerce_map_value": _standard(_map_answer),
        "coerce_json_dump": _standard(_struct_answer),
        "coerce_scalars": _standard(_scalar_fields),
        "coerce_list": _standard(_word_lists),
        "coerce_json_content": _standard(d.json_blocks, json_content=True),
        "coerce_json_deep": _standard(_deep_json, json_content=True),
        "coerce_json_deeper": _standard(_deeper_json, json_content=True),
        # targets
        "chat_to_text": _converted(d.chatml, "text"),
        "roles_to_text": _converted(d.spellings, "text"),
        "pref_to_text": _converted(d.preference, "text"),
        "text_to_chat": _converted(d.text, "chatml"),
        "pref_to_chat": _converted(d.preference, "chatml"),
        "pref_to_pref": _converted(d.preference, "preference"),
        # combining
        "concat_provenance": concat_provenance,
        "align_missing": align_missing,
        "interleave_round_robin": _mixed(None, "all_exhausted"),
        "interleave_round_robin_first": _mixed(None, "first_exhausted"),
        "interleave_weighted": _mixed(WEIGHTS, "all_exhausted"),
        "interleave_weighted_first": _mixed(WEIGHTS, "first_exhausted"),
        "interleave_unnormalized": _mixed([10 * w for w in WEIGHTS], "first_exhausted"),
        # cleaning
        "system_prompt": system_prompt,
        "length_filter_chat": _filtered(d.chatml, "chatml", "chatml", 500, 5000),
        "length_filter_text": _filtered(d.text, "text", "text", None, 2000),
        "length_filter_pref": _filtered(d.preference, "preference", "preference", 1000, None),
        "dedupe_text": _deduped(d.text, "text", "text"),
        "dedupe_chat": _deduped(d.twice, "chatml", "chatml"),
        "dedupe_pref": _deduped(d.preference, "preference", "preference"),
        "dedupe_normalized": _deduped(d.near_copies, "text", "text", normalize=True),
        "dedupe_strict": _deduped(d.twice, "chatml", "chatml", strict=True),
        "dedupe_examples": dedupe_examples,
        "dedupe_examples_chat": dedupe_examples_chat,
        # choosing and ordering
        "head_cap": head_cap,
        "sample_fraction": sample_fraction,
        "shuffle_order": shuffle_order,
        "train_test_split": train_test_split,
        "train_test_count": train_test_count,
        "row_numbers": row_numbers,
        # reports
        "quality_by_source": quality_by_source,
        "quality_overall": quality_overall,
        "quality_preference": quality_preference,
        "source_report": source_report,
        "source_report_twice": source_report_twice,
        "source_counts": source_counts,
        "role_counts": role_counts,
        "length_histogram": length_histogram,
        "merge_counters": merge_counters,
        "merge_lengths": merge_lengths,
        "merge_roles": merge_roles,
        # the job
        "full_merge": _merged(),
        "full_merge_text": _merged(target_format="text", system_prompt=None),
        "full_merge_interleave": _merged(mode="interleave", probabilities=[0.2, 0.3, 0.4, 0.1]),
        "full_merge_repeats": _merged(mode="interleave", dedupe=False),
        # files
        "merge_jsonl_interleave": merge_jsonl_interleave,
        "merge_jsonl_capped_sampled": merge_jsonl_capped_sampled,
        "merge_view_without_order": merge_view_without_order,
        "merge_many_roles": merge_many_roles,
        "merge_role_top": merge_role_top,
        "refusals": refusals,
        "card_counts": card_counts,
        "merge_from_file": merge_from_file,
        "read_csv": _read_back("csv"),
        "read_csv_two_headers": read_csv_two_headers,
        "read_jsonl": _read_back("jsonl"),
        "read_json": read_json,
        "read_json_split": read_json_split,
        "read_parquet_order": read_parquet_order,
        "read_capped": read_capped,
        "read_table": read_table,
        "write_round_trip": write_round_trip,
        "publish_round_trip": publish_round_trip,
        "saved_preview": saved_preview,
        "stream_ingest": stream_ingest,
    }
