"""Records told apart by many tasks, against Python's own reader and Spark's one-task reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import csv_records as R


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def invented(seed, n=80):
    pick = random.Random(seed)
    parts = ["a", "5\" pipe", "x,y", "two\nlines", '"', '""', "", "\n", "é", "end\"", ",\"", "\n\n,\"\n", "long " * 30]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for i in range(n):
        writer.writerow([str(i), *("".join(pick.choices(parts, k=pick.randrange(3))) for _ in range(3))])
        if pick.random() < 0.1:
            out.write("\n")
    # A quote inside a field that is not quoted is a character.
    out.write('80,5" pipe,x"y,z\n81,"a ""b"" c",,"d\ne"\n82,last,,')
    return out.getvalue()


def records(spark, folder):
    return R.csv_records(spark, str(folder))


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_reader_that_sees_the_whole_file(tiny_splits, tmp_path, seed):
    texts = {f"f{k}.csv": invented(10 * seed + k) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = records(tiny_splits, tmp_path).withColumn("cells", R.cells(F.col("text"), 4)).collect()
    splits = R.physical_lines(tiny_splits, str(tmp_path), "*.csv").select("path", "begin").distinct().count()
    assert splits > 60
    for name, text in texts.items():
        told = [row for row in csv.reader(io.StringIO(text)) if row]
        mine = {r.number: [c or "" for c in r.cells] for r in found if r.path.endswith(name)}
        assert sorted(mine) == list(range(1, len(told) + 1))
        assert [mine[i + 1] for i in range(len(told))] == told


def test_equals_the_reader_of_one_task(tiny_splits, tmp_path):
    (tmp_path / "f.csv").write_text(invented(99), encoding="utf-8")
    schema = ", ".join(f"c{i} string" for i in range(4))
    one = tiny_splits.read.schema(schema).option("multiLine", "true").option("escape", '"').csv(str(tmp_path)).collect()
    many = records(tiny_splits, tmp_path).withColumn("cells", R.cells(F.col("text"), 4)).orderBy("number").collect()
    assert [list(r.cells) for r in many] == [list(r) for r in one]


def test_line_ends_blank_files_and_open_quotes(tiny_splits, tmp_path):
    (tmp_path / "crlf.csv").write_bytes(b'a,b\r\n"x\r\ny",1\r\n\r\nz,2\r\n')
    (tmp_path / "blank.csv").write_bytes(b"\n\n\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "open.csv").write_bytes(b'a,b\n"never,\nclosed,' + b"x\n" * 200)
    found = {}
    for r in records(tiny_splits, tmp_path).orderBy("number").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append(r.text)
    assert found == {"crlf.csv": ["a,b", '"x\ny",1', "z,2"], "open.csv": ["a,b", '"never,\nclosed,' + "x\n" * 199 + "x"]}


def test_no_file_is_one_task(tiny_splits, tmp_path):
    (tmp_path / "f.csv").write_text("\n".join(f'{i},"a\nb"' for i in range(400)), encoding="utf-8")
    lines = R.physical_lines(tiny_splits, str(tmp_path), "*.csv")
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 20
    plan = R._told(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == 1 and "begin" in plan.split("Exchange hashpartitioning(")[1][:60]
    assert records(tiny_splits, tmp_path).count() == 400
