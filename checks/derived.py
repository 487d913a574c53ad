"""Sources of every layout, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_blend import dense_index, with_position

TURN_BITS = 32
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return with_position(docs, "key")


def content(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("key"), F.col("html").alias("content")
    )
    return with_position(pages, "key")


def chats(spark, sf_dir, column: str, role: str, said: str, turn=None) -> DataFrame:
    """One row per conversation, which is what a chat source holds, with its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    spoken = turn(F.col("role"), F.col("text")) if turn else (F.col("role"), F.col("text"))
    entry = F.struct("turn", F.struct(spoken[0].alias(role), spoken[1].alias(said)).alias("t"))
    grouped = turns.groupBy(F.col("conv_id").alias("key")).agg(
        F.array_sort(F.collect_list(entry)).alias("turns")
    )
    ordered = F.transform("turns", lambda e: e.getField("t")).alias(column)
    return with_position(grouped.select("key", ordered), "key")


def chatml(spark, sf_dir) -> DataFrame:
    return chats(spark, sf_dir, "messages", "role", "content")


def sharegpt(spark, sf_dir) -> DataFrame:
    def spelled(role, said):
        name = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
        return name, said

    return chats(spark, sf_dir, "conversations", "from", "value", spelled)


def spellings(spark, sf_dir) -> DataFrame:
    """Chats with other spellings of the roles, one unknown and one missing."""

    def spelled(role, said):
        user = F.when(F.length(said) % 2 == 0, "Human").otherwise("USER")
        reply = F.when(F.length(said) % 3 == 0, "Bot").when(F.length(said) % 3 == 1, "tool_use")
        return F.when(role == "user", user).when(role == "assistant", reply).otherwise("AI"), said

    return chats(spark, sf_dir, "messages", "role", "content", spelled)


def _lines(said):
    return F.split(said, "\n")


def blocks(spark, sf_dir) -> DataFrame:
    def in_parts(role, said):
        parts = F.transform(
            _lines(said), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
        )
        image = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"))
        return role, F.concat(parts, F.array(image))

    return chats(spark, sf_dir, "messages", "role", "content", in_parts)


def typed_blocks(spark, sf_dir) -> DataFrame:
    """Parts without text or content: a text part's value is read, an image is dropped."""

    def in_parts(role, said):
        words = F.transform(
            _lines(said), lambda x: F.struct(F.lit("text").alias("type"), x.alias("value"))
        )
        image = F.struct(F.lit("image_url").alias("type"), F.lit("x.png").alias("value"))
        return role, F.concat(F.array(image), words)

    return chats(spark, sf_dir, "messages", "role", "content", in_parts)


def content_blocks(spark, sf_dir) -> DataFrame:
    def in_parts(role, said):
        return role, F.transform(_lines(said), lambda x: F.struct(x.alias("content")))

    return chats(spark, sf_dir, "messages", "role", "content", in_parts)


def json_blocks(spark, sf_dir) -> DataFrame:
    """Some contents are plain text, others the same text as a JSON list of parts."""

    def as_json(role, said):
        parts = F.transform(
            _lines(said), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
        )
        return role, F.when(role == "assistant", F.to_json(parts)).otherwise(said)

    return chats(spark, sf_dir, "messages", "role", "content", as_json)


def twice(spark, sf_dir) -> DataFrame:
    """Chats, and every one of them again under a later position."""
    rows = chatml(spark, sf_dir)
    return rows.unionByName(rows.withColumn("_src", F.lit(1)))


def qa(spark, sf_dir) -> DataFrame:
    """A user turn and the reply that follows it; equi-join, so no long conversation is hot."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("next"), F.col("text").alias("question")
    )
    replies = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("answer")
    )
    key = (F.shiftleft("conv_id", TURN_BITS) + F.col("turn")).alias("key")
    pairs = asked.join(replies, ["conv_id", "next"]).select(
        key, "question", "answer", "conv_id", "turn"
    )
    return with_position(pairs, "key")


def renamed_qa(spark, sf_dir, question: str, answer: str) -> DataFrame:
    return qa(spark, sf_dir).withColumnsRenamed({"question": question, "answer": answer}).drop(
        "conv_id", "turn"
    )


def half_empty(spark, sf_dir) -> DataFrame:
    blank = F.col("conv_id") % 4 == 0
    cells = {c: F.when(blank, " ").otherwise(F.col(c)) for c in ("question", "answer")}
    return qa(spark, sf_dir).withColumns(cells).drop("conv_id", "turn")


def first_line(name: str):
    return F.substring_index(name, "\n", 1)


def alpaca(spark, sf_dir) -> DataFrame:
    kind = F.col("doc_id") % 3
    context = F.when(kind == 1, "").when(kind == 2, first_line("text"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.concat(F.lit("Continue this text in "), "lang").alias("instruction"),
        context.alias("input"),
        F.col("text").alias("output"),
    )
    return with_position(docs, "key")


def preference(spark, sf_dir) -> DataFrame:
    """Good texts, each with a bad one of its language; bad ones are used in turn.

    Who goes with whom is worked out on ids; texts are joined to the finished pairs.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labelled = docs.drop("text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    numbered = dense_index(
        labelled.withColumn("_kind", F.concat_ws("/", "lang", "quality")),
        ["_kind", "doc_id"],
        within="_kind",
    )
    good = numbered.where("quality = 1").select("lang", F.col("doc_id").alias("key"), F.col("_index").alias("r"))
    bad = numbered.where("quality = 0").select("lang", F.col("_index").alias("b"), F.col("doc_id").alias("other"))
    sizes = bad.groupBy("lang").agg(F.count("*").alias("n"))
    ids = (
        good.join(sizes, "lang")
        .withColumn("b", F.col("r") % F.col("n"))
        .join(bad, ["lang", "b"])
        .select("key", "other")
    )
    chosen = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("chosen"))
    rejected = docs.select(F.col("doc_id").alias("other"), F.col("text").alias("rejected"))
    pairs = ids.join(chosen, "key").join(rejected, "other")
    return with_position(pairs.select("key", first_line("chosen").alias("prompt"), "chosen", "rejected"), "key")


def near_copies(spark, sf_dir) -> DataFrame:
    """Texts, all of them again in capitals behind spaces, and again with doubled spaces."""
    rows = text(spark, sf_dir)
    loud = F.concat(F.lit("  "), F.translate("text", *LETTERS))
    wide = F.replace("text", F.lit(" "), F.lit("  "))
    return rows.unionByName(
        rows.withColumns({"text": loud, "_src": F.lit(1)})
    ).unionByName(rows.withColumns({"text": wide, "_src": F.lit(2)}))
