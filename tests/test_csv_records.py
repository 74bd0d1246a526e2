"""Splittable CSV equals the one-task reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from alertweave.sources import csv_records, readers


def rows_in_order(df):
    columns = [c for c in df.columns if c != "o"]
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: tuple(r["o"]))]


def whole_files(spark, path):
    """Spark's reader: each file in one task."""
    df = spark.read.csv(path, header=True, inferSchema=False, **csv_records.OPTIONS)
    return [tuple(x or "" for x in r) for r in df.collect()]


@pytest.fixture()
def small_splits(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key in sizes:
        spark.conf.unset(key)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n"), (4, "\n")])
def test_equals_the_one_task_reader(spark, tmp_path, small_splits, seed, end):
    pick = random.Random(seed)
    bits = ["a", "é", ",", '"', "\n", " ", "\n\n", '""', "long text " * 4]
    path = tmp_path / "d.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL)
        out.writerow(["id", "some text", "c"])
        for i in range(80):
            out.writerow([i, "".join(pick.choices(bits, k=pick.randint(0, 12))), pick.choice(["", "x", "y\nz" * 30])])
    df = readers.read_dataset(spark, str(path), "o")
    assert df.rdd.getNumPartitions() > 10
    want = whole_files(spark, str(path))
    assert len(want) == 80 and rows_in_order(df) == want
    with open(path, newline="", encoding="utf-8") as f:
        assert rows_in_order(df) == [tuple(r) for r in list(csv.reader(f))[1:]]


def test_many_files_headers_across_borders_and_odd_rows(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('"id","' + "n\n" * 60 + '"\n1,2\n\n3\n4,5,6\n')
    (tmp_path / "b.csv").write_text('id,t\n"7","' + "x\n" * 90 + '"\n8,""\n9,"open to the end\n')
    (tmp_path / "c.csv").write_text("id,t")
    got = rows_in_order(readers.read_dataset(spark, str(tmp_path), "o"))
    assert sorted(r[0] for r in got) == ["1", "3", "4", "7", "8", "9"]
    assert [r for r in got if r[0] in "1348"] == [("1", "2"), ("3", ""), ("4", "5"), ("8", "")]
    assert [r[1] for r in got if r[0] == "7"] == ["x\n" * 90]


def test_parity_of_splits():
    parity = [("a", 0, 1, True), ("a", 5, 0, False), ("a", 9, 0, True), ("a", 12, 1, True), ("a", 15, 0, False),
              ("b", 0, 0, False), ("b", 7, 1, True), ("b", 9, 0, False)]
    assert csv_records.starts_inside(reversed(parity)) == {("a", 5): 0, ("a", 9): 0, ("a", 12): 9, ("b", 9): 7}


def test_last_row_of_a_key_in_a_split_file(spark, tmp_path, small_splits):
    from alertweave.operators import training

    with open(tmp_path / "d.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "t"])
        out.writerows([[i % 7, f"row\n{i}"] for i in range(60)])
    rows = training.keyed_rows(readers.read_dataset(spark, str(tmp_path / "d.csv"), "o"), "id", ["o"])
    assert {r["id"]: r["t"] for r in rows.select("id", "t").collect()} == {str(i % 7): f"row\n{i}" for i in range(53, 60)}


def test_no_rows(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,t\n")
    df = readers.read_dataset(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["id", "t"] and df.count() == 0 and df.filter(F.col("id") == "").count() == 0
