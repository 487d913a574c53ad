"""CSV files split inside quoted cells, against the same files read whole."""

from __future__ import annotations

import random

import pytest

from corpus_blend.operators.select import first_rows
from corpus_blend.sources import csv_records
from corpus_blend.sources.load import load_file


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def whole(spark, path):
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "FAILFAST", "enforceSchema": False}
    return [tuple(r) for r in spark.read.options(**options).csv(path).collect()]


def split(spark, path, **options):
    rows = load_file(spark, path, "csv", missing_cells=False, **options)
    found = rows.orderBy("_src", "_file", "_row").drop("_src", "_file", "_row").collect()
    return [tuple(r) for r in found]


def cell(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(["plain", 'a 5" pipe', "", "é\U0001f600", "x" * 90])
    inner = "".join(rng.choice(['""', ",", "\n", "b", " ", '""\n', "\n\n", "z" * 40]) for _ in range(rng.randrange(9)))
    return f'"{inner}"' + rng.choice(["", "", "", "tail", 'odd"tail'])


@pytest.mark.parametrize("seed,end", [(0, "\n"), (1, "\n"), (2, "\r\n")])
def test_split_anywhere(spark, tmp_path, small_blocks, seed, end):
    rng = random.Random(seed)
    rows = [",".join(cell(rng) for _ in range(3)) for _ in range(30)]
    path = tmp_path / "a.csv"
    text = end.join(["a,b,c", *rows]) + rng.choice(["", end])
    path.write_bytes(text.encode())
    assert load_file(spark, str(path)).select("_file").distinct().count() > 5 or end == "\r\n"
    assert split(spark, str(path)) == whole(spark, str(path))


def test_a_cell_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, with a comma" for i in range(40))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,"{long}"\n3,end\n')
    assert split(spark, str(tmp_path / "a.csv")) == [("1", long), ("2", long), ("3", "end")]
    rows = load_file(spark, str(tmp_path / "a.csv"))
    assert [r.k for r in first_rows(rows, 2).orderBy("_file", "_row").collect()] == ["1", "2"]


def test_one_file_is_many_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{i},"a\nb"\n' for i in range(200)))
    rows = load_file(spark, str(tmp_path / "a.csv"))
    assert rows.count() == 200 and rows.select("_file").distinct().count() > 10


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n")
    (tmp_path / "b.csv").write_text("")
    rows = load_file(spark, str(tmp_path), "csv")
    assert rows.count() == 0 and rows.columns[:2] == ["k", "v"]


def test_a_header_over_two_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"k\nk",v\n1,"2\n3"\n')
    assert split(spark, str(tmp_path)) == [("1", "2\n3")]


def test_more_kinds_of_headers_than_one_reading_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_records, "HEADERS_AT_ONCE", 2)
    for i in range(5):
        (tmp_path / f"{i:02d}.csv").write_text(f'c{i},text\n{i},"a\n{i}"\n')
    rows = load_file(spark, str(tmp_path), "csv")
    assert sorted(r.text for r in rows.select("text").collect()) == sorted(f"a\n{i}" for i in range(5))
    assert len(rows.columns) == 5 + 1 + 3


def test_folder_names_give_columns(spark, tmp_path):
    for day in ("1", "2"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a.csv").write_text(f'k\n"x\n{day}"\n')
    rows = load_file(spark, str(tmp_path), "csv").select("k", "day").collect()
    assert sorted((r.k, r.day) for r in rows) == [("x\n1", 1), ("x\n2", 2)]


def test_declared_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"a\nb"\n')
    assert split(spark, str(tmp_path / "a.csv"), schema="k int, v string") == [(1, "a\nb")]
    assert split(spark, str(tmp_path / "a.csv"), schema="k int, v string", multi_line=True, order_by="k") == [(1, "a\nb")]
    with pytest.raises(ValueError, match="not the schema's"):
        load_file(spark, str(tmp_path / "a.csv"), schema="v string, k int")


def test_without_line_breaks_in_cells(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{i},"a,{i}"\n' for i in range(200)) + "k,v\n")
    assert split(spark, str(tmp_path / "a.csv"), multi_line=False) == [(str(i), f"a,{i}") for i in range(200)] + [("k", "v")]
