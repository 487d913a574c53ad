"""JSON lists split anywhere, against the same lists read by Python."""

from __future__ import annotations

import json
import random

import pytest

from corpus_blend.sources import json_records
from corpus_blend.sources.load import load_file


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def read(spark, path, **options):
    rows = load_file(spark, str(path), "json", **options)
    return [r.asDict(recursive=True) for r in rows.orderBy("_src", "_file", "_row").drop("_src", "_file", "_row").collect()]


def text(rng: random.Random) -> str:
    parts = ["}", "{", '"', "\\", "[", "]", ",", "\n", "é\U0001f600", "x" * 70, '\\"}', "}," * 30, " "]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(8)))


@pytest.mark.parametrize("seed,indent", [(0, None), (1, 2), (2, None), (3, 1)])
def test_split_anywhere(spark, tmp_path, small_blocks, seed, indent):
    rng = random.Random(seed)
    turn = lambda: {"role": text(rng), "content": text(rng)}
    files = [
        [{"id": i, "text": text(rng), "turns": [turn() for _ in range(rng.randrange(4))], "at": {"}": text(rng)}} for i in range(n)]
        for n in (40, 1, 7)
    ]
    for i, rows in enumerate(files):
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=seed % 2 == 0) + " \n" * (seed % 2))
    found = load_file(spark, str(tmp_path), "json")
    assert found.select("_file").distinct().count() > 8
    assert found.select("_file", "_row").distinct().count() == 48
    assert read(spark, tmp_path) == [r for rows in files for r in rows]


def test_a_record_over_many_blocks(spark, tmp_path, small_blocks):
    rows = [{"k": 1, "v": "}" * 1500}, {"k": 2, "v": 'a "{' * 400}, {"k": 3, "v": ""}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert read(spark, tmp_path / "a.json") == rows
    assert read(spark, tmp_path / "a.json", order_by="k") == rows
    assert read(spark, tmp_path / "a.json", schema="v string, k int") == rows


def test_empty_lists_and_files(spark, tmp_path, small_blocks):
    (tmp_path / "a.json").write_text(" [ ]\n")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    assert load_file(spark, str(tmp_path), "json").count() == 0
    (tmp_path / "d.json").write_text('[{"a": 1}]')
    assert read(spark, tmp_path) == [{"a": 1}]


def test_folder_names_give_columns(spark, tmp_path, small_blocks):
    for day in (1, 2):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a.json").write_text(json.dumps([{"k": "x}" * 50}, {"k": str(day)}]))
    assert read(spark, tmp_path) == [{"k": k, "day": d} for d in (1, 2) for k in ("x}" * 50, str(d))]


def test_a_single_object_is_read_whole(spark, tmp_path, small_blocks):
    (tmp_path / "a.json").write_text(json.dumps({"k": 1, "v": "}" * 100}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"k": 2, "v": "b"}, {"k": 3, "v": "c"}]))
    assert read(spark, tmp_path) == [{"k": 1, "v": "}" * 100}, {"k": 2, "v": "b"}, {"k": 3, "v": "c"}]


@pytest.mark.parametrize(
    "broken",
    [
        '[{"a": 1}, {"a": 2}',
        '[{"a": 1}, {"a": 2',
        '[{"a": 1} {"a": 2}]',
        '[{"a": 1}, {"a": "x}]',
        '[{"a": 1}, {"a" 2}]',
        '[{"a": 1}], {"a": 2}]',
        '[{"a": 1}, 5, {"a": 2}]',
        '[{"a": 1}, ]',
    ],
)
def test_broken_lists_are_errors(spark, tmp_path, small_blocks, broken):
    (tmp_path / "a.json").write_text(broken)
    with pytest.raises(Exception):
        load_file(spark, str(tmp_path), "json").collect()


def test_sizes_as_settings_spell_them():
    assert [json_records._bytes(s) for s in ("64", "4MB", "1g", "2 kb".replace(" ", ""))] == [64, 4 << 20, 1 << 30, 2048]
