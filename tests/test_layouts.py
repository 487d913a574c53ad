"""Layouts, coercion and targets on the small shapes a merge tool has to cope with."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_blend as cb
from corpus_blend.operators.report import inspect_source

PARTS = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def frame(spark, schema, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def messages(df, fmt=None, columns=None, **options):
    found = cb.detect_format(df, fmt)
    row = cb.standardize(df, found, columns, **options).collect()
    return [[(m.role, m.content) for m in r.messages] for r in row]


CASES = [
    (
        "instruction string, input string, output string",
        ("Translate to French", "Hello", "Bonjour"),
        "alpaca",
        [("user", "Translate to French\n\nHello"), ("assistant", "Bonjour")],
    ),
    (
        "conversations array<struct<`from`:string,value:string>>",
        ([("human", "hi"), ("gpt", "hello!")],),
        "sharegpt",
        [("user", "hi"), ("assistant", "hello!")],
    ),
    (
        "messages array<struct<role:string,content:string>>",
        ([("user", "hi"), ("assistant", "hello!")],),
        "chatml",
        [("user", "hi"), ("assistant", "hello!")],
    ),
    (
        "prompt string, response string",
        ("2+2=", "4"),
        "prompt_completion",
        [("user", "2+2="), ("assistant", "4")],
    ),
    (
        "question string, answer string",
        ("Capital of France?", "Paris"),
        "qa",
        [("user", "Capital of France?"), ("assistant", "Paris")],
    ),
    (
        "input string, output string",
        ("some code", "explanation"),
        "input_output",
        [("user", "some code"), ("assistant", "explanation")],
    ),
    (
        "task_description string, model_answer string",
        ("Summarize this article", "A short summary."),
        "alpaca_fuzzy",
        [("user", "Summarize this article"), ("assistant", "A short summary.")],
    ),
    (
        f"messages {PARTS}",
        (
            [
                ("user", [("text", "hi there")]),
                ("assistant", [("text", "hello!"), ("image_url", None), ("text", "how can I help?")]),
            ],
        ),
        "chatml",
        [("user", "hi there"), ("assistant", "hello!\nhow can I help?")],
    ),
    (
        "question string, answer struct<text:string>",
        ("What's the weather?", ("Sunny today",)),
        "qa",
        [("user", "What's the weather?"), ("assistant", "Sunny today")],
    ),
]


@pytest.mark.parametrize("schema, row, fmt, expected", CASES, ids=[c[2] for c in CASES])
def test_layout(spark, schema, row, fmt, expected):
    df = frame(spark, schema, row)
    assert cb.detect_format(df) == fmt
    assert messages(df) == [expected]


def test_text_and_preference(spark):
    texts = frame(spark, "text string", ("The quick brown fox...",))
    assert cb.detect_format(texts) == "text"
    assert cb.standardize(texts, "text").first().text == "The quick brown fox..."
    pairs = frame(spark, "prompt string, chosen string, rejected string", ("Write", "Good", "Bad"))
    assert cb.detect_format(pairs) == "preference"
    assert tuple(cb.standardize(pairs, "preference").first()) == ("Write", "Good", "Bad")


def test_preference_of_message_lists_without_prompt(spark):
    turns = "array<struct<role:string,content:string>>"
    df = frame(
        spark,
        f"chosen {turns}, rejected {turns}",
        ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "")]),
    )
    assert tuple(cb.standardize(df, "preference").first()) == ("", "a\nb", "a")


def test_unknown_and_malformed(spark):
    odd = frame(spark, "foo int, bar int", (1, 2))
    assert cb.detect_format(odd) == "unknown"
    with pytest.raises(ValueError, match="foo, bar"):
        cb.to_target(odd, "unknown", "chatml", "odd")
    malformed = frame(spark, "conversations string", ("not a list",))
    assert cb.detect_format(malformed) == "unknown"
    assert messages(malformed, "sharegpt") == [[]]


def test_detection_order_and_override(spark):
    df = frame(spark, "input string, output string, instruction string, text string", "abcd")
    assert cb.detect_format(df) == "alpaca"
    assert cb.detect_format(df, "text") == "text"
    assert cb.detect_format(df, "auto") == "alpaca"
    with pytest.raises(ValueError, match="unknown format"):
        cb.detect_format(df, "alpacca")


def test_empty_turn_lists(spark):
    df = frame(spark, "id int, messages array<struct<role:string,content:string>>", (1, []), (2, [("user", "x")]))
    placed = cb.with_position(df.coalesce(1), "id")
    assert cb.detect_format(placed) == "chatml"
    assert cb.detect_format(placed, strict_first_row=True) == "unknown"


def test_turns_as_maps(spark):
    df = frame(spark, "conversations array<map<string,string>>", ([{"from": "human", "value": "hi"}, {"value": "x"}],))
    assert cb.detect_format(df) == "sharegpt"
    assert messages(df) == [[("user", "hi"), ("user", "x")]]


def test_roles(spark):
    df = frame(
        spark,
        "messages array<struct<role:string,content:string>>",
        ([("Human", "1"), ("BOT", "2"), ("Tool", "3"), (None, "4"), None],),
    )
    assert messages(df) == [[("user", "1"), ("assistant", "2"), ("Tool", "3"), (None, "4")]]


def test_alpaca_context(spark):
    df = frame(
        spark,
        "instruction string, input string, output string",
        ("q", None, "a"),
        ("q", "", "a"),
        ("q", " ", None),
    )
    asked = [m[0][1] for m in messages(df)]
    assert sorted(asked) == ["q", "q", "q\n\n "]


def test_exact_names(spark):
    df = frame(spark, "Instruction string, Output string", ("q", "a"))
    assert cb.detect_format(df) == "alpaca"
    assert messages(df) == [[("user", ""), ("assistant", "")]]
    assert messages(df, case_insensitive=True) == [[("user", "q"), ("assistant", "a")]]


def test_null_completion_is_not_replaced(spark):
    df = frame(spark, "prompt string, completion string, response string", ("p", None, "r"))
    assert messages(df) == [[("user", "p"), ("assistant", "")]]


def test_manual_columns(spark):
    df = frame(spark, "q_txt string, a_txt string", ("q", "a"))
    given = {"prompt_key": "q_txt", "completion_key": "a_txt"}
    assert messages(df, "prompt_completion", given) == [[("user", "q"), ("assistant", "a")]]
    assert messages(df, "alpaca_fuzzy", {"mapping": {"instruction": "q_txt"}}) == [
        [("user", "q"), ("assistant", "")]
    ]
    with pytest.raises(ValueError, match="prompt_column"):
        cb.standardize(df, "prompt_completion", {"prompt_column": "q_txt"})


def test_fuzzy_mapping():
    assert cb.fuzzy_mapping(["resource", "user_query", "bot_reply"]) == {
        "instruction": "user_query",
        "input": "resource",
        "output": "bot_reply",
    }
    both = cb.fuzzy_mapping(["question_answer"])
    assert both == {"instruction": "question_answer", "output": "question_answer"}
    assert cb.fuzzy_mapping(["a", "b"]) is None


COERCED = [
    ("int", 7, "7"),
    ("double", 1.0, "1.0"),
    ("boolean", True, "True"),
    ("boolean", False, "False"),
    ("string", None, ""),
    ("array<string>", ["a", None, "", "b"], "a\nb"),
    ("array<array<int>>", [[1, 2], [], [3]], "1\n2\n3"),
    ("struct<text:string,content:string>", (None, "set"), ""),
    ("struct<value:struct<content:int>>", ((5,),), "5"),
    ("struct<b:int,a:string>", (1, 'é"\n'), '{"b": 1, "a": "é\\"\\n"}'),
    ("struct<a:array<boolean>,m:map<string,int>>", ([True, None], {"k": 2}), '{"a": [true, null], "m": {"k": 2}}'),
    ("map<string,string>", {"value": "v", "content": None}, ""),
    ("map<string,string>", {"value": "v", "x": "y"}, "v"),
    ("map<string,int>", {"x": 1}, '{"x": 1}'),
    ("array<struct<content:string>>", [("a",), (None,), ("b",)], "a\nb"),
    ("array<struct<type:string,url:string>>", [("image_url", "u"), (None, "v")], '{"type": null, "url": "v"}'),
    ("array<struct<type:string,value:string>>", [("text", "t"), ("audio", "z")], "t"),
    ("array<map<string,string>>", [{"type": "image"}, {"type": "text", "text": "t"}, {"value": "v"}], "t\nv"),
]


@pytest.mark.parametrize("dtype, value, expected", COERCED)
def test_coercion(spark, dtype, value, expected):
    df = frame(spark, f"question string, answer {dtype}", ("q", value))
    assert messages(df) == [[("user", "q"), ("assistant", expected)]]


JSON_TEXTS = [
    ('[{"type":"text","text":"a"},{"type":"image_url","image_url":{"url":"u"}},"b"]', "a\nb"),
    ('{"content":[{"text":"x"},{"content":{"value":"y"}}]}', "x\ny"),
    ('[1, true, null, "z"]', "1\nTrue\nz"),
    ('[{"type":"text","value":"v"},{"type":"audio","value":"w"}]', "v"),
    ('{"text":null,"content":"c"}', ""),
    ("[not json", "[not json"),
    ("plain", "plain"),
]


@pytest.mark.parametrize("text, expected", JSON_TEXTS)
def test_json_content(spark, text, expected):
    df = frame(spark, "question string, answer string", ("q", text))
    assert messages(df, json_content=True)[0][1] == ("assistant", expected)
    assert messages(df)[0][1] == ("assistant", text)


def test_targets(spark):
    chat = frame(
        spark,
        "messages array<struct<role:string,content:string>>",
        ([("system", "s"), ("user", "q"), ("assistant", "a"), ("tool_use", "t"), (None, "n")],),
    )
    text = cb.to_target(chat, "chatml", "text", "lab", "dev").first()
    assert text.text == (
        "### System:\ns\n\n### Instruction:\nq\n\n### Response:\na\n\n### Tool_Use:\nt\n\n### Instruction:\nn"
    )
    assert (text.source_dataset, text.source_split) == ("lab", "dev")
    pairs = frame(spark, "prompt string, chosen string, rejected string, other int", ("p", "c", "r", 1))
    assert cb.to_target(pairs, "preference", "text").first().text == "### Instruction:\np\n\n### Response:\nc"
    assert cb.to_target(pairs, "preference", "chatml").columns == ["messages", "source_dataset", "source_split"]
    with pytest.raises(ValueError, match="preference"):
        cb.to_target(chat, "chatml", "preference")
    with pytest.raises(ValueError, match="target"):
        cb.to_target(chat, "chatml", "chat")
    empty = chat.withColumn("messages", F.lit(None).cast(chat.schema[0].dataType))
    assert cb.to_target(empty, "chatml", "text").first().text == ""


def test_inspect(spark):
    row = inspect_source(frame(spark, "text string, n int", ("a", None)), "here").first()
    assert tuple(row) == ("here", "text", 1, ["text", "n"], '{"text":"a","n":null}')
    empty = inspect_source(frame(spark, "text string", ("a",)).where("false"), "here").first()
    assert tuple(empty) == ("here", "text", 0, ["text"], None)


def test_scan_reads_only_what_is_mapped(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    frame(spark, "text string, lang string, n int", ("a", "b", 1)).write.parquet(path)
    shaped = cb.to_target(spark.read.parquet(path), "text", "chatml")
    plan = shaped._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert int(found.stdout) > 80, found.stderr
