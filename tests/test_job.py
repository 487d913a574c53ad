"""Reading, writing and the whole merge, checked against a plain Python merge."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F
from test_rows import by_weight, number, round_robin

import corpus_blend as cb
from corpus_blend.__main__ import main
from corpus_blend.plans import merge
from corpus_blend.plans.spec import MergeSpec, SourceSpec, load_config
from corpus_blend.sinks.files import card_text, preview, publish, save
from corpus_blend.sources import load
from corpus_blend.sources.load import load_file, load_source
from corpus_blend.staging import shared_folder
from corpus_blend.streaming.ingest import ingest

# --- files -----------------------------------------------------------------------


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"a ""quoted"" word"\n2,"two\nlines"\n007,NA\n4,\n5,plain\n')
    rows = load_file(spark, str(path), multi_line=True).orderBy("_file", "_row").collect()
    assert [(r.id, r.text) for r in rows] == [
        ("1", 'a "quoted" word'),
        ("2", "two\nlines"),
        ("007", None),
        ("4", None),
        ("5", "plain"),
    ]
    kept = load_file(spark, str(path), multi_line=True).where("id = '007'")
    assert kept.first().text is None
    raw = cb.load_file(spark, str(path), multi_line=True, missing_cells=False)
    assert raw.where("id = '007'").first().text == "NA"


def test_jsonl_keeps_text_and_order(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(json.dumps({"text": f"{i:03d}"}) + "\n" for i in range(50)))
    rows = load_file(spark, str(path))
    assert [r.text for r in rows.orderBy("_src", "_file", "_row").collect()] == [f"{i:03d}" for i in range(50)]
    assert sorted(r.text for r in cb.first_rows(rows, 3).collect()) == ["000", "001", "002"]


def test_json_document_and_broken_lines(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"question": "q", "answer": {"text": "a"}}, {"question": "r"}]))
    rows = load_file(spark, str(path))
    assert rows.count() == 2 and cb.detect_format(rows) == "qa"
    broken = tmp_path / "b.jsonl"
    broken.write_text('{"text": "a"}\n{"text": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        load_file(spark, str(broken)).collect()


def test_mixed_shapes_in_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [
        {"messages": [{"role": "user", "content": "plain"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url"}]}]},
    ]
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))
    rows = load_file(spark, str(path))
    read = cb.standardize(rows, cb.detect_format(rows), json_content=True).orderBy("_row").collect()
    assert [r.messages[0].content for r in read] == ["plain", "a"]


def test_unsupported_file(spark):
    with pytest.raises(ValueError, match="csv, json, jsonl, parquet"):
        load_file(spark, "a.xlsx")


def test_parquet_positions_across_files(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(100).repartitionByRange(5, "id").write.parquet(path)
    rows = load_file(spark, path)
    assert [r.id for r in rows.orderBy("_file", "_row").collect()] == list(range(100))
    assert sorted(r.id for r in cb.first_rows(rows, 33).collect()) == list(range(33))


@pytest.mark.parametrize("n, opened", [(5, 1), (30, 2), (45, 4), (500, 5)])
def test_a_cap_opens_only_the_first_files(spark, tmp_path, monkeypatch, n, opened):
    path = str(tmp_path / "many")
    asked = []
    whole = load.load_file
    monkeypatch.setattr(load, "load_file", lambda s, p, *a, **k: asked.append(p) or whole(s, p, *a, **k))
    spark.range(100).selectExpr("id", "string(id) AS text").repartitionByRange(5, "id").write.json(path)
    rows = load_source(spark, SourceSpec(local_path=path, reader="jsonl", max_samples=n))
    assert sorted(r.id for r in rows.collect()) == list(range(min(n, 100)))
    assert len(asked[-1]) == opened


def test_a_cap_keeps_columns_of_later_files_and_of_folders(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q"}\n')
    (tmp_path / "b.jsonl").write_text('{"question": "r", "answer": "s"}\n')
    both = str(tmp_path / "*.jsonl")
    rows = load_source(spark, SourceSpec(local_path=both, max_samples=1))
    assert cb.detect_format(rows) == "qa" and rows.count() == 1
    streamed = load_source(spark, SourceSpec(local_path=both, max_samples=1, streaming=True))
    assert cb.detect_format(streamed) == "qa"
    parted = str(tmp_path / "parted")
    spark.createDataFrame([("x", "en"), ("y", "fr")], "text string, lang string").write.partitionBy("lang").parquet(parted)
    rows = load_source(spark, SourceSpec(local_path=parted, reader="parquet", max_samples=1))
    assert [(r.text, r.lang) for r in rows.collect()] == [("x", "en")]
    one = str(tmp_path / "a.jsonl")
    assert load_source(spark, SourceSpec(local_path=one, max_samples=3)).count() == 1


def test_order_by_two_columns(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "f string, n int")
    placed = cb.with_position(df, ["f", "n"]).orderBy("_file", "_row").collect()
    assert [(r.f, r.n) for r in placed] == [("a", 1), ("a", 2), ("b", 1)]
    for bad in (["n", "f"], ["n", "n"]):
        with pytest.raises(ValueError, match="order_by"):
            cb.with_position(df, bad)


def test_table_source(spark):
    df = spark.createDataFrame([(i, str(i), "train" if i % 2 else "test") for i in range(20)], "id int, text string, split string")
    df.createOrReplaceTempView("t_table")
    spec = SourceSpec(repo_id="t_table", split="test", order_by="id", max_samples=6, sample_fraction=0.5)
    rows = load_source(spark, spec).collect()
    assert len(rows) == 3 and all(r.id in (0, 2, 4, 6, 8, 10) for r in rows)


@pytest.mark.parametrize("formats", [["jsonl"], ["csv", "parquet", "jsonl"]])
def test_save(spark, tmp_path, formats):
    df = spark.createDataFrame(
        [(i, [("user", f'a "{i}",\n'), (None, "é")], "test" if i == 3 else "train") for i in range(6)],
        "id int, messages array<struct<role:string,content:string>>, split string",
    )
    written = save(df, str(tmp_path / "out"), formats)
    assert sorted(written) == sorted(formats)
    for kind, folder in written.items():
        back = load_file(spark, folder, kind, multi_line=True)
        if kind == "csv":
            back = back.withColumn("messages", F.from_json("messages", "array<struct<role:string,content:string>>"))
        got = {int(r.id): ([(m.role, m.content) for m in r.messages], r.split) for r in back.collect()}
        assert got == {r.id: ([(m.role, m.content) for m in r.messages], r.split) for r in df.collect()}
    if "jsonl" in formats:
        assert preview(spark, written["jsonl"] + "/split=train", 2).count() == 2
    with pytest.raises(ValueError, match="xml"):
        save(df, str(tmp_path / "no"), ["xml"])


def test_publish(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    publish(df, "published")
    assert spark.table("published").where("split = 'test'").first().id == 2


def test_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spec = SourceSpec(local_path=source, reader="jsonl", schema="text string, id int", format="text")
    df = spark.createDataFrame([("a", 1), (None, 2)], "text string, id int")
    df.write.json(source)
    ingest(spark, spec, "chatml", out, state, keep=["id"])
    df.withColumn("id", F.col("id") + 10).write.mode("append").json(source)
    ingest(spark, spec, "chatml", out, state, files_per_batch=1, keep=["id"])
    got = {r.id: r.messages[0].content for r in spark.read.parquet(out).collect()}
    assert got == {1: "a", 2: "", 11: "a", 12: ""}
    with pytest.raises(ValueError, match="schema"):
        ingest(spark, SourceSpec(local_path=source, reader="jsonl"), "chatml", out)


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# --- configuration -------------------------------------------------------------------


@pytest.mark.parametrize(
    "config, message",
    [
        ({"datasets": []}, "nothing"),
        ({"datasets": [{}]}, "repo_id"),
        ({"datasets": [{"repo_id": "a", "formt": "qa"}]}, "formt"),
        ({"datasets": [{"repo_id": "a", "format": "qaa"}]}, "qaa"),
        ({"datasets": [{"repo_id": "a", "columns": {"q": "x"}}]}, "q"),
        ({"datasets": [{"repo_id": "a"}], "output": {"mode": "zip"}}, "zip"),
        ({"datasets": [{"repo_id": "a"}], "output": {"target_format": "xml"}}, "xml"),
        ({"datasets": [{"repo_id": "a"}], "output": {"save_formats": ["xml"]}}, "xml"),
        ({"datasets": [{"repo_id": "a"}], "output": {"mode": "interleave", "probabilities": [1, 2]}}, "weights"),
        ({"datasets": [{"repo_id": "a"}] * 2, "output": {"mode": "interleave", "probabilities": [1, 0]}}, "weight 0"),
    ],
)
def test_refused(config, message):
    with pytest.raises(ValueError, match=message):
        MergeSpec.from_dict(config)


def test_config_files(tmp_path):
    config = {"datasets": [{"local_path": "a.jsonl", "columns": None, "format": "auto"}], "output": {"seed": 1, "push_to_hub": ""}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    spec = load_config(str(tmp_path / "c.json"))
    assert (spec.sources[0].columns, spec.sources[0].format, spec.output.seed) == ({}, None, 1)
    assert spec.output.push_to_hub is None and spec.output.save_formats == ["jsonl"]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.dump(config))
    assert load_config(str(tmp_path / "c.yaml")) == spec


# --- the whole job ----------------------------------------------------------------------

PAIRS = [(f"q{i % 9}", f"a{i % 9}" if i % 5 else " ") for i in range(23)]
TEXTS = ["t" * (i % 13) for i in range(40)] + ["  "]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "pairs.jsonl").write_text(
        "".join(json.dumps({"question": q, "answer": a}) + "\n" for q, a in PAIRS)
    )
    (tmp_path / "texts.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in TEXTS))
    return [str(tmp_path / "pairs.jsonl"), str(tmp_path / "texts.jsonl")]


def modelled(out, files):
    """The same merge, row after row."""
    rows = [
        [(files[0], [("user", q), ("assistant", a)]) for q, a in PAIRS],
        [(files[1], [("assistant", t)]) for t in TEXTS],
    ]
    sizes = [len(r) for r in rows]
    if out.get("mode") == "interleave":
        stop = out.get("stopping_strategy", "all_exhausted")
        if out.get("probabilities"):
            picks = by_weight(sizes, out["probabilities"], out.get("seed", 42), stop)
        else:
            picks = round_robin(sizes, stop)
        merged = [rows[s][i] for s, i in picks]
    else:
        merged = rows[0] + rows[1]
    before = len(merged)
    if out.get("system_prompt"):
        merged = [(s, [("system", out["system_prompt"]), *m]) for s, m in merged]
    sized = [(sum(len(c) for _, c in m), s, m) for s, m in merged]
    low, high = out.get("min_length", 0), out.get("max_length", 10**9)
    kept = [(s, m) for n, s, m in sized if low <= n <= high]
    final, seen, dropped = [], set(), []
    for s, m in kept:
        payload = "||".join(f"{r}:{' '.join(c.split()).lower() if out.get('normalize_dedupe') else c}" for r, c in m)
        if out.get("dedupe", True) and payload in seen:
            dropped.append({"source": s, "preview": m[0][1][:140]})
            continue
        seen.add(payload)
        final.append((s, m))
    return before, len(kept), final, dropped[:3]


JOBS = [
    {},
    {"min_length": 3, "max_length": 9, "normalize_dedupe": True, "train_test_split": 0.2, "stage_text": False},
    {"system_prompt": "S", "shuffle": False, "train_test_split": 4},
    {"dedupe": False, "shuffle": False, "stage_text": True},
    {"mode": "interleave", "max_length": 8},
    {"mode": "interleave", "dedupe": False, "min_length": 2, "train_test_split": 0.5},
    {"mode": "interleave", "probabilities": [3, 1], "seed": 5},
    {"mode": "interleave", "stopping_strategy": "first_exhausted", "normalize_dedupe": True},
    {"mode": "interleave", "probabilities": [1, 3], "stopping_strategy": "first_exhausted"},
    {"mode": "interleave", "probabilities": [1, 3], "shuffle": False, "max_length": 9},
    {"mode": "interleave", "probabilities": [3, 1], "dedupe": False, "stopping_strategy": "first_exhausted"},
]


@pytest.mark.parametrize("out", JOBS, ids=str)
def test_merge(spark, files, tmp_path, out):
    spec = MergeSpec.from_dict(
        {"datasets": [{"local_path": f} for f in files], "output": {**out, "save_path": str(tmp_path / "o")}}
    )
    summary = cb.run_merge(spark, spec)
    before, after, final, dropped = modelled(out, files)
    assert summary["rows_before_filters"] == before
    assert summary["rows_after_filters"] == after
    assert summary["final_rows"] == len(final)
    assert summary["duplicates_removed"] == after - len(final)
    assert summary["duplicate_examples"] == dropped
    written = spark.read.json(summary["save_files"]["jsonl"])
    got = sorted((r.source_dataset, [(m.role, m.content) for m in r.messages]) for r in written.collect())
    assert got == sorted(final)
    splits = {r["split"]: r["count"] for r in written.groupBy("split").count().collect()}
    share = out.get("train_test_split")
    test = math.ceil(len(final) * share) if isinstance(share, float) else share or 0
    assert splits.get("test", 0) == summary["splits"].get("test", 0) == test
    assert splits["train"] == summary["splits"]["train"] == len(final) - test
    counts = {}
    for s, _ in final:
        counts[s] = counts.get(s, 0) + 1
    assert summary["source_counts"] == counts
    roles = {}
    for _, m in final:
        for r, _ in m:
            roles[r] = roles.get(r, 0) + 1
    assert summary["role_counts"] == roles
    assert sum(b["n_rows"] for b in summary["lengths"]) == len(final)
    blank = sum(all(not c.strip() for _, c in m) for _, m in final)
    assert summary["quality"]["empty_rows"] == blank
    assert [s["rows"] for s in summary["sources"]] == [len(PAIRS), len(TEXTS)]
    assert [s["quality"]["empty_rows"] for s in summary["sources"]] == [0, sum(not t.strip() for t in TEXTS)]
    card = spark.read.text(summary["dataset_card"], wholetext=True).first()[0]
    assert card.strip() == card_text(summary).strip()
    assert ("system prompt" in card) == bool(out.get("system_prompt"))


def test_final_order(spark, files):
    spec = MergeSpec.from_dict({"datasets": [{"local_path": f} for f in files], "output": {"train_test_split": 0.3}})
    blend = merge.Blend(spark, spec)
    rows = [(r.split, r.messages) for r in blend.final(1).collect()]
    assert [s for s, _ in rows] == sorted((s for s, _ in rows))
    wide = [(r.split, r.messages) for r in blend.final(5).collect()]
    for split in ("train", "test"):
        assert [m for s, m in wide if s == split] == [m for s, m in rows if s == split]
    hashes = {tuple(map(tuple, r.messages)): r._hash.hex() for r in blend.rows.collect()}
    train = [number(42, hashes[tuple(map(tuple, m))]) for s, m in rows if s == "train"]
    assert train == sorted(train)


def test_hot_copies_are_dropped_before_the_exchange(spark, tmp_path, monkeypatch):
    path = tmp_path / "hot.jsonl"
    texts = ["hot"] * 500 + ["warm"] * 3 + [f"t{i}" for i in range(50)]
    path.write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    monkeypatch.setattr(merge, "HOT_COPIES", 10)
    blend = merge.Blend(spark, MergeSpec.from_dict({"datasets": [{"local_path": str(path)}]}))
    rows = blend._without_hot_copies(blend.rows)
    assert rows.where(F.col("messages")[0].content == "hot").count() == 1
    assert rows.where(F.col("messages")[0].content == "warm").count() == 3
    assert sorted(r.messages[0].content for r in blend.final(3).collect()) == sorted(set(texts))


def test_text_moves_once(spark, files):
    spec = MergeSpec.from_dict({"datasets": [{"local_path": f} for f in files], "output": {"train_test_split": 0.3}})
    plan = merge.Blend(spark, spec).final(4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("weights", [None, [2, 1]])
def test_interleaved_text_moves_once(spark, files, weights):
    out = {"mode": "interleave", "probabilities": weights}
    spec = MergeSpec.from_dict({"datasets": [{"local_path": f} for f in files], "output": out})
    plan = merge.Blend(spark, spec).final(4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("out", [{}, {"mode": "interleave"}, {"mode": "interleave", "probabilities": [1, 2, 1], "dedupe": False}])
def test_sources_without_rows(spark, files, tmp_path, out):
    nothing = str(tmp_path / "nothing")
    spark.createDataFrame([], "text string").write.parquet(nothing)
    empty = {"local_path": nothing, "reader": "parquet"}
    settings = {**out, "save_path": str(tmp_path / "o"), "min_length": 1}
    spec = MergeSpec.from_dict({"datasets": [{"local_path": files[0]}, empty, {"local_path": files[1]}], "output": settings})
    summary = cb.run_merge(spark, spec)
    assert [s["rows"] for s in summary["sources"]] == [len(PAIRS), 0, len(TEXTS)]
    before, after, final, _ = modelled({**settings, "probabilities": [1, 1] if "probabilities" in out else None}, files)
    assert (summary["rows_before_filters"], summary["rows_after_filters"]) == (before, after)
    assert summary["final_rows"] == len(final)
    weights = {"probabilities": [1, 2]} if "probabilities" in out else {}
    spec = MergeSpec.from_dict({"datasets": [empty, empty], "output": {**settings, **weights}})
    summary = cb.run_merge(spark, spec)
    assert summary["final_rows"] == 0 and summary["splits"] == {"train": 0}


def test_example_config():
    spec = load_config(os.path.join(os.path.dirname(__file__), "..", "examples", "config.yaml"))
    assert [s.label for s in spec.sources] == ["/data/chats", "/data/answers/*.jsonl", "corpus.raw_texts"]
    assert spec.output.push_to_hub is None


def test_several_formats_and_a_table(spark, files, tmp_path):
    spec = MergeSpec.from_dict(
        {
            "datasets": [{"local_path": files[0]}],
            "output": {"save_path": str(tmp_path / "o"), "save_formats": ["csv", "parquet"], "push_to_hub": "merged_pairs", "target_format": "text"},
        }
    )
    summary = cb.run_merge(spark, spec)
    n = summary["final_rows"]
    assert spark.read.parquet(summary["save_files"]["parquet"]).count() == n
    assert load_file(spark, summary["save_files"]["csv"], "csv", multi_line=True).count() == n
    assert spark.table("merged_pairs").count() == n
    assert "role_counts" not in summary


def test_blank_source_is_flagged(spark, tmp_path):
    path = tmp_path / "wrong.jsonl"
    path.write_text('{"Text": "a"}\n{"Text": "b"}\n')
    spec = MergeSpec.from_dict({"datasets": [{"local_path": str(path)}], "output": {"save_path": str(tmp_path / "o")}})
    summary = cb.run_merge(spark, spec)
    assert summary["sources"][0]["quality"]["flagged"] and "column mapping" in summary["warnings"][0]


def test_commands(spark, files, tmp_path, capsys):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"datasets": [{"local_path": f} for f in files], "output": {"save_path": str(tmp_path / "o")}}))
    main(["inspect", str(config)])
    found = json.loads(capsys.readouterr().out)["inspected"]
    assert [(f["source"], f["format"], f["n_rows"]) for f in found] == [(files[0], "qa", 23), (files[1], "text", 41)]
    main(["merge", str(config)])
    assert json.loads(capsys.readouterr().out)["rows_before_filters"] == 64
