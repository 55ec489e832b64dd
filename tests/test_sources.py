"""CSV files as people write them, shared folders, and counts beyond the top k."""

import csv
import gzip
import random

import pytest
from pyspark.sql import types as T

from weirworks.operators.compare import compare_counts
from weirworks.session import shared_dir
from weirworks.sources import tables

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])


def written(tmp_path, text):
    path = tmp_path / "table.csv"
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns_are_found_by_name(spark, tmp_path):
    path = written(tmp_path, "b,extra,a\n1,q,x\n2,q,N/A\n")
    assert rows(tables.scan_csv(spark, path, SCHEMA)) == [("x", 1), (None, 2)]
    assert rows(tables.scan_csv(spark, path, SCHEMA, columns=["b"])) == [(1,), (2,)]
    with pytest.raises(ValueError, match="absent"):
        tables.scan_csv(spark, written(tmp_path, "a,c\n1,2\n"), SCHEMA)


def test_rows_that_do_not_fit_are_seen(spark, tmp_path):
    path = written(tmp_path, "a,b\nx,1\nz,2,3\ny,4\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        tables.scan_csv(spark, path, SCHEMA).collect()
    assert rows(tables.scan_csv(spark, path, SCHEMA, broken="drop")) == [("x", 1), ("y", 4)]
    assert rows(tables.scan_csv(spark, path, SCHEMA, broken="keep")) == [("x", 1), ("y", 4), ("z", 2)]
    assert rows(tables.broken_rows(spark, path)) == [("z,2,3",)]
    with pytest.raises(ValueError):
        tables.scan_csv(spark, path, SCHEMA, broken="ignore")


def test_line_breaks_within_quotes(spark, tmp_path):
    path = written(tmp_path, 'a,b\n"x\ny, ""z""",1\n')
    assert rows(tables.scan_csv(spark, path, SCHEMA, multi_line=True)) == [('x\ny, "z"', 1)]


def test_split_scan_has_more_tasks_and_the_same_rows(spark, tmp_path):
    path = written(tmp_path, "a,b\n" + "".join(f"name {i},{i}\n" for i in range(20_000)))
    split = tables.scan_split(spark, path, SCHEMA, block_bytes=32 * 1024)
    assert split.rdd.getNumPartitions() > tables.scan_csv(spark, path, SCHEMA).rdd.getNumPartitions()
    assert rows(split) == rows(tables.scan_csv(spark, path, SCHEMA))


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\nx,1\n")
    (tmp_path / "two.csv").write_text("b,a,more\n2,y,q\n3,z\n")
    (tmp_path / "_SUCCESS").write_text("")
    with gzip.open(tmp_path / "three.csv.gz", "wt") as file:
        file.write("b,a\n4,w\n")
    for multi_line in (False, True):
        assert rows(tables.scan_csv(spark, str(tmp_path), SCHEMA, broken="drop", multi_line=multi_line)) == [("w", 4), ("x", 1), ("y", 2)]
        assert rows(tables.broken_rows(spark, str(tmp_path), multi_line)) == [("3,z",)]
        with pytest.raises(ValueError, match="absent"):
            tables.scan_csv(spark, str(tmp_path), T.StructType([*SCHEMA, T.StructField("more", T.StringType())]), multi_line=multi_line)
    with pytest.raises(FileNotFoundError):
        tables.scan_csv(spark, str(tmp_path / "nothing*"), SCHEMA)


def test_quoted_line_breaks_in_many_blocks(spark, tmp_path):
    rng = random.Random(5)

    def cell(i):
        kind = rng.random()
        if kind < 0.3:
            return f"plain {i}"
        if kind < 0.9:
            return "\n".join(rng.choice(['say ""hi""', "x,y", "", "1,2", '""', "\r"]) for _ in range(rng.randint(1, 9)))
        return "long\n" * rng.randint(50, 900)  # longer than a block

    text = "a,b\n" + "".join(f'"{cell(i)}",{i}\n' for i in range(1500)) + "last,-1"
    path = tmp_path / "t.csv"
    path.write_text(text, newline="")
    split = tables.scan_split(spark, str(path), SCHEMA, block_bytes=2048, strings=(), multi_line=True)
    with open(path, newline="") as file:
        wanted = sorted((a, int(b)) for a, b in list(csv.reader(file))[1:])
    assert len(wanted) == 1501 and split.rdd.getNumPartitions() > 8
    assert sorted((r.a or "", r.b) for r in split.collect()) == wanted
    crlf = tmp_path / "w.csv"
    crlf.write_text('a,b\r\n"x\r\ny",1\r\nz,2\r\n', newline="")
    assert rows(tables.scan_csv(spark, str(crlf), SCHEMA, multi_line=True)) == [("x\r\ny", 1), ("z", 2)]


def test_counts_of_values_beyond_the_other_top(spark):
    before = spark.createDataFrame([(v,) for v in "aaaabbbccd"], "v string")
    after = spark.createDataFrame([(v,) for v in "abccccddd"] + [(None,)], "v string")
    assert rows(compare_counts(before, after, "v", 2)) == [("a", 4, 1), ("b", 3, 1), ("c", 2, 4), ("d", 1, 3)]


def test_unshared_scratch_is_for_single_machines():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_counting_a_scan_sees_broken_rows(spark, tmp_path):
    path = written(tmp_path, "a,b\nx,1\nz,2,3\n")
    assert tables.scan_csv(spark, path, SCHEMA, broken="drop").count() == 1
    with pytest.raises(Exception, match="wrong number of fields"):
        tables.scan_csv(spark, path, SCHEMA, columns=["a"]).count()
