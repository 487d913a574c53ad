"""That no row is lost or made up, whatever the settings of the moment, and that sources survive."""

import json

import pytest
from pyspark.sql import functions as F

import corpus_blend as cb
from corpus_blend.operators.detect import detect_format
from corpus_blend.plans import merge
from corpus_blend.plans.merge import Blend, run_merge
from corpus_blend.plans.spec import MergeSpec, SourceSpec
from corpus_blend.sinks.files import card_text, preview
from corpus_blend.sources.load import load_file, load_source
from corpus_blend.staging import shared_folder


def json_lines(spark, folder, n, word):
    spark.range(n).select(F.concat(F.lit(f"{word} "), "id").alias("text")).repartition(5).write.json(str(folder))
    return {"local_path": str(folder), "reader": "jsonl"}


def text_merge(datasets, **output):
    settings = {"target_format": "text", "shuffle": False, "dedupe": False, "save_path": None, **output}
    return MergeSpec.from_dict({"datasets": datasets, "output": settings})


@pytest.fixture
def settings(spark):
    """Change session settings; they are put back."""
    before = {}

    def change(**values):
        for name, value in values.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("output", [{"mode": "interleave"}, {"mode": "interleave", "dedupe": True, "shuffle": True}, {"dedupe": True}])
def test_rows_do_not_depend_on_cores_or_splits(spark, tmp_path, settings, output):
    settings(spark__sql__files__openCostInBytes="1k", spark__sql__leafNodeDefaultParallelism="2")
    spec = text_merge([json_lines(spark, tmp_path / "a", 900, "a"), json_lines(spark, tmp_path / "b", 400, "b")], **output)
    blend = Blend(spark, spec)
    planned = blend.n_final
    settings(spark__sql__leafNodeDefaultParallelism="64", spark__sql__files__maxPartitionBytes="2k")
    texts = [r.text for r in blend.final().select("text").collect()]
    assert len(texts) == planned == (1300 if output.get("dedupe") else 1800)
    assert set(texts) == {f"a {i}" for i in range(900)} | {f"b {i}" for i in range(400)}


def test_samples_and_caps_are_exact_without_an_order(spark, tmp_path, settings):
    settings(spark__sql__leafNodeDefaultParallelism="2")
    source = json_lines(spark, tmp_path / "a", 1000, "a")
    rows = load_source(spark, SourceSpec(**source, sample_fraction=0.3))
    capped = load_source(spark, SourceSpec(**source, max_samples=123))
    settings(spark__sql__leafNodeDefaultParallelism="64", spark__sql__files__maxPartitionBytes="2k")
    assert rows.count() == 300 and capped.count() == 123


@pytest.mark.parametrize("keys", [[1, 2, 2], [1, None, 3]])
def test_order_by_must_name_every_row(spark, keys):
    spark.createDataFrame([(k, "x") for k in keys], "k int, text string").createOrReplaceTempView("t_keys")
    with pytest.raises(ValueError, match="must name every row"):
        load_source(spark, SourceSpec(repo_id="t_keys", order_by="k"))


def test_fewer_rows_written_than_planned_is_an_error(spark, tmp_path, monkeypatch):
    final = merge.Blend.final
    monkeypatch.setattr(merge.Blend, "final", lambda self, *a: final(self, *a).limit(3))
    spec = text_merge([json_lines(spark, tmp_path / "a", 20, "a")], save_path=str(tmp_path / "out"))
    with pytest.raises(RuntimeError, match="3 rows were written, but 20"):
        run_merge(spark, spec)


def test_a_merge_deletes_what_it_staged_and_restores_settings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merge, "ROWS_PER_SHUFFLE_TASK", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    folder = f"{shared_folder(spark)}/corpus_blend"
    system = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    runs = lambda: [p for s in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run-*")) or [] for p in [s]]
    spec = text_merge(
        [json_lines(spark, tmp_path / "a", 20, "a")], save_path=str(tmp_path / "out"), save_formats=["jsonl", "parquet", "csv"]
    )
    found = run_merge(spark, spec)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and not runs()
    assert {k: list(v) for k, v in found["files"].items()} == {k: ["train"] for k in ("parquet", "jsonl", "csv")}
    for kind, folder in found["save_files"].items():
        assert load_file(spark, folder, kind).count() == 20
    with open(tmp_path / "out" / "README.md", encoding="utf-8") as file:
        assert file.read() == card_text(found)
    assert preview(spark, found["save_files"]["jsonl"], 5).count() == 5


def test_a_source_is_not_written_over(spark, tmp_path):
    source = json_lines(spark, tmp_path / "out" / "in", 5, "a")
    with pytest.raises(ValueError, match="holds the source"):
        run_merge(spark, text_merge([source], save_path=str(tmp_path / "out")))
    assert load_file(spark, source["local_path"], "jsonl").count() == 5


def test_one_table_listed_twice(spark, tmp_path):
    rows = [(i, f"t{i}", "train" if i < 7 else "test") for i in range(10)]
    spark.createDataFrame(rows, "id int, text string, split string").createOrReplaceTempView("t_twice")
    source = {"repo_id": "t_twice", "order_by": "id"}
    spec = text_merge([source | {"split": "train"}, source | {"split": "test"}], save_path=str(tmp_path / "out"))
    found = run_merge(spark, spec)
    assert [(s["rows"], s["rows_kept"]) for s in found["sources"]] == [(7, 7), (3, 3)]
    card = card_text(found)
    assert "| `t_twice` | text | 7 | 7 |" in card and "| `t_twice` | text | 3 | 3 |" in card and "| final_rows | 10 |" in card


def test_more_roles_than_a_summary_lists(spark, tmp_path):
    """The most frequent ones are listed, by the same rule at any number; all are in the files."""
    said = lambda name: F.struct(name.alias("role"), F.lit("x").alias("content"))
    often = F.when(F.col("id") < 1400, "often").otherwise(F.concat(F.lit("z"), "id"))
    rows = spark.range(1500).select("id", F.array(said(F.concat(F.lit("r"), "id")), said(often)).alias("messages"))
    rows.createOrReplaceTempView("t_many_roles")
    spec = MergeSpec.from_dict(
        {"datasets": [{"repo_id": "t_many_roles", "order_by": "id"}], "output": {"dedupe": False, "save_path": str(tmp_path / "out")}}
    )
    found = run_merge(spark, spec)
    names = sorted([f"r{i}" for i in range(1500)] + [f"z{i}" for i in range(1400, 1500)])
    assert found["n_roles"] == 1601 and found["role_counts"] == {"often": 1400} | dict.fromkeys(names[:999], 1)
    assert spark.read.json(found["role_counts_path"]).count() == 1601


# --- CSV and paths ------------------------------------------------------------------------


def test_csv_cells_are_not_dropped(spark, tmp_path):
    (tmp_path / "extra.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        load_file(spark, str(tmp_path / "extra.csv"))


def test_csv_line_breaks_and_headers(spark, tmp_path):
    folder = tmp_path / "with space 100%"
    folder.mkdir()
    (folder / "a b.csv").write_text('question,answer\n"q\n1",a1\n')
    (folder / "c%20d.csv").write_text("answer,question,more\na2,q2,m\n")
    rows = load_file(spark, str(folder), "csv").collect()
    assert sorted((r.question, r.answer, r.more) for r in rows) == [("q\n1", "a1", None), ("q2", "a2", "m")]
    capped = load_source(spark, SourceSpec(local_path=str(folder), reader="csv", max_samples=1)).collect()
    assert [(r.question, r.answer) for r in capped] == [("q\n1", "a1")]


def test_caps_and_previews_of_odd_paths(spark, tmp_path):
    folder = tmp_path / "odd %20 [x] {y}"
    folder.mkdir()
    for name, n in (("a 1.jsonl", 2), ("b%41.jsonl", 2)):
        (folder / name).write_text("".join(json.dumps({"text": f"{name} {i}"}) + "\n" for i in range(n)))
    escaped = str(folder).replace("[", r"\[").replace("]", r"\]").replace("{", r"\{").replace("}", r"\}")
    rows = load_source(spark, SourceSpec(local_path=escaped, reader="jsonl", max_samples=3)).collect()
    assert sorted(r.text for r in rows) == ["a 1.jsonl 0", "a 1.jsonl 1", "b%41.jsonl 0"]


# --- layouts and texts --------------------------------------------------------------------


def test_a_layout_does_not_depend_on_the_first_rows(spark):
    turn = "array<struct<from:string,value:string>>"
    rows = spark.createDataFrame([([],)] * 9 + [([("human", "x")],)], f"conversations {turn}")
    assert detect_format(rows) == "sharegpt" and detect_format(rows.limit(0)) == "sharegpt"
    maps = spark.createDataFrame([([],)] * 9 + [([{"role": "user", "content": "x"}],)], "messages array<map<string,string>>")
    assert detect_format(maps) == "chatml"
    other = spark.createDataFrame([([{"role": "user"}],)], "messages array<map<string,string>>")
    assert detect_format(other) == "unknown"


def json_text(spark, value):
    rows = spark.createDataFrame([(value,)], "text string")
    return cb.standardize(rows, "text", json_content=True).first().text


def test_json_messages(spark):
    assert json_text(spark, '{"b": 1, "a": 2}') == '{"b": 1, "a": 2}'
    deep = "x"
    for i in range(7):
        deep = [deep, {"text": deep}][i % 2] if i else {"value": deep}
        deep = [deep] if not isinstance(deep, list) else deep
    assert json_text(spark, json.dumps(deep)) == "x"
    assert json_text(spark, "[" * 40 + '"x"' + "]" * 40) == "x"


def test_an_exported_configuration_may_hold_a_name_without_effect():
    with pytest.warns(UserWarning, match="eval_split"):
        spec = MergeSpec.from_dict({"datasets": [{"repo_id": "t", "eval_split": "test"}]})
    assert spec.sources[0].split == "train"


@pytest.mark.parametrize(("config", "message"), [
    ({"datasets": []}, "nothing to combine"), ({"datasets": [{}]}, "needs repo_id"),
    ({"datasets": [{"repo_id": "t", "format": "x"}]}, "unknown format"), ({"datasets": [{"repo_id": "t"}], "output": {"mode": "x"}}, "unknown mode"),
    ({"datasets": [{"repo_id": "t"}], "output": {"save_formats": ["x"]}}, "unknown save formats"),
    ({"datasets": [{"repo_id": "t", "colums": {}}]}, "unknown settings"),
])
def test_refusals(config, message):
    with pytest.raises(ValueError, match=message):
        MergeSpec.from_dict(config)


def test_inspecting_without_counting(spark, tmp_path):
    source = json_lines(spark, tmp_path / "a", 30, "a")
    spec = MergeSpec.from_dict({"datasets": [source]})
    row = cb.inspect_sources(spark, spec, count=False).first()
    assert (row.n_rows, row.columns, row.format) == (None, ["text"], "text")
    full = cb.inspect_sources(spark, spec, profile=True).first()
    assert full.n_rows == 30 and full.n_missing == 0 and full.avg_length > 2
