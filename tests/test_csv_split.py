"""CSV split over tasks equals the reader that takes a file whole."""
import random

import pytest
from pyspark.sql import functions as F

from oriel.sources import tables as tb
from oriel.sources.csvsplit import read_csv_split


def whole(spark, path):
    return (spark.read.schema(tb.RAW_REVIEW_SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("mode", "FAILFAST").csv(path))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def body(rng):
    return "".join(rng.choice(["word ", "\n", "\n\n", '"', ",", "é", " ", '""', ",\"\n"]) for _ in range(rng.randint(1, 40))).strip() + "."


def test_one_file_over_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "t", 'a "b"']), rng.choice([None, body(rng), body(rng)])) for i in range(400)]
    path = str(tmp_path / "one")
    tb.write_csv(spark.createDataFrame(data, tb.RAW_REVIEW_SCHEMA).coalesce(1), path)
    got = tb.read_reviews_csv(spark, path)
    lines = spark.read.text(path)
    assert lines.rdd.getNumPartitions() > 20
    assert rows(got) == rows(whole(spark, path)) and got.count() == 400


def test_files_with_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = '\n'.join(f'line {i}, with "quotes"' for i in range(300))
    for k in range(3):
        tb.write_csv(spark.createDataFrame([(k, "a", long), (k + 10, "b", "x"), (k + 20, None, long[::-1])], tb.RAW_REVIEW_SCHEMA).coalesce(1), str(tmp_path / f"d{k}"))
    path = str(tmp_path / "*")
    assert rows(tb.read_reviews_csv(spark, path)) == rows(whole(spark, path))


def test_line_ends_and_empty_files(spark, tmp_path):
    p = tmp_path / "crlf.csv"
    p.write_bytes(b'review_id,title,reviews\r\n1,a,"two\r\nlines"\r\n\r\n2,,"say ""hi"""\r\n3,"x,y",last')
    assert rows(read_csv_split(spark, str(p), tb.RAW_REVIEW_SCHEMA)) == [(1, "a", "two\nlines"), (2, None, 'say "hi"'), (3, "x,y", "last")]
    (tmp_path / "none.csv").write_text("")
    assert tb.read_reviews_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "head.csv").write_text("review_id,title,reviews\n")
    assert tb.read_reviews_csv(spark, str(tmp_path / "head.csv")).count() == 0
