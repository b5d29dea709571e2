"""Delimited text read in several splits, with newlines in quotes, against one that reads it in a piece."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.sources.tables import quoted_records, read_delimited, read_upload


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    yield spark
    spark.conf.set(key, before)


def written(path, n=400):
    rng, rows = random.Random(2), [["name", "a long, note", "x"]]
    for i in range(n):
        note = rng.choice(["plain", "two\nlines", 'says ""', "a, b", "\n\n", "x" * 900 + "\ny", ""])
        rows.append([f"r{i}", note.replace('""', '"hi"'), str(i)])
    with open(path, "w", newline="") as f:
        csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    return rows


def test_records_are_whole_in_any_split(small_splits, tmp_path):
    path = tmp_path / "quoted.csv"
    rows = written(path)
    records = quoted_records(small_splits, str(path))
    assert small_splits.read.text(str(path)).rdd.getNumPartitions() > 8
    got = [next(csv.reader([r.record + "\n"])) if "\n" not in r.record else next(csv.reader(r.record.splitlines(keepends=True))) for r in records.orderBy("block", "n").collect()]
    assert got == rows


def test_splits_equal_one_piece(small_splits, tmp_path):
    path = tmp_path / "quoted.csv"
    rows = written(path)
    df = read_delimited(small_splits, str(path))
    whole = small_splits.read.csv(str(path), header=True, multiLine=True, escape='"')
    want = {(r["name"], (r["a long, note"] or "").strip() or None, r["x"]) for r in whole.collect()}
    assert df.columns == rows[0] and df.count() == len(rows) - 1 and {tuple(r) for r in df.collect()} == want
    assert read_delimited(small_splits, str(path), ordered=False).rdd.getNumPartitions() > 1


def test_odd_files(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("\ufeffa;b\r\n1;\"x;\r\ny\"\r\n\r\n;;\r\n2\r\n3;4;5".encode())
    df = read_delimited(spark, str(tmp_path / "bom.csv"))
    assert df.columns == ["a", "b"] and sorted((r.a, (r.b or "").replace("\r", "")) for r in df.collect()) == [("1", "x;\ny"), ("2", ""), ("3", "4")]
    (tmp_path / "upload.csv").write_text('n,t\n1,"u\nv"\nNA,w\n2.5,\n')
    up = read_upload(spark, str(tmp_path / "upload.csv"))
    assert up.dtypes == [("n", "double"), ("t", "string")] and sorted(up.select(F.coalesce("n", F.lit(0.0)), "t").collect(), key=str) == sorted([(1.0, "u\nv"), (0.0, "w"), (2.5, None)], key=str)
    (tmp_path / "empty.csv").write_text("\n \n")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "empty.csv"))
