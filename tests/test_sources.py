"""Delimited files as they come: damaged headers, several files, declared types."""

from __future__ import annotations

from tabgrove.sources.shared import shared_folder

import pytest
from pyspark.sql import types as T

from tabgrove.operators.clean import clean_columns
from tabgrove.plans.jobs import read_clean
from tabgrove.sources.delimited import inferred_types, read_delimited

# First, inner and last names carry different numbers of quotes.
HEADER = '"""fixed part"""";""""a.b"""";""""count"""""'


def write(folder, *files):
    for i, lines in enumerate(files):
        (folder / f"part-{i}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture
def damaged(tmp_path):
    return write(
        tmp_path,
        [HEADER, "7.4;0.7;11", "7.8;;25"],
        [HEADER, "1e3;-0.5;3"],
    )


ROWS = [(7.4, 0.7, 11.0), (7.8, None, 25.0), (1000.0, -0.5, 3.0)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_inferred(spark, damaged):
    raw = read_delimited(spark, damaged)
    assert [tuple(r) for r in inferred_types(raw).collect()] == [
        (0, "fixed part", "double"),
        (1, "a.b", "double"),
        (2, "count", "int"),
    ]
    clean = clean_columns(raw)
    assert clean.columns == ["fixed part", "a.b", "count"]
    assert rows(clean) == sorted(ROWS, key=str)


def test_text_scan_gives_the_same_rows(spark, damaged):
    raw = read_delimited(spark, damaged, infer_schema=False)
    assert {t for _, t in raw.dtypes} == {"string"}
    assert rows(read_clean(spark, damaged, infer_schema=False)) == sorted(ROWS, key=str)


DECLARED = (
    T.StructType().add("fixed part", "double").add("a.b", "double").add("count", "integer")
)


def test_declared_scan(spark, damaged):
    clean = read_clean(spark, damaged, schema=DECLARED)
    assert rows(clean) == sorted(ROWS, key=str)
    assert clean.count() == 3
    assert rows(clean.select("count")) == sorted([(11.0,), (25.0,), (3.0,)], key=str)


def test_declared_names_must_match(spark, damaged):
    moved = T.StructType([DECLARED[1], DECLARED[0], DECLARED[2]])
    with pytest.raises(ValueError, match="header holds"):
        read_delimited(spark, damaged, schema=moved)


def test_every_file_header_is_checked(spark, tmp_path):
    path = write(tmp_path, ["a;b", "1;2"], ["b;a", "3;4"])
    declared = T.StructType.fromDDL("a int, b int")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, path, schema=declared).collect()


def test_file_uri_and_separator(spark, tmp_path):
    path = write(tmp_path, ["a,b", "1,2"])
    assert rows(read_clean(spark, f"file://{path}", sep=",")) == [(1.0, 2.0)]


@pytest.mark.parametrize("infer", [True, False])
def test_booleans_and_times_become_numbers(spark, tmp_path, infer):
    path = write(
        tmp_path,
        ["a;b;c;d;e", "true;1970-01-02 00:00:00;x;2020-01-01;True", "FALSE;1970-01-03T00:00:00.5;1;2020-01-02;2"],
    )
    assert rows(read_clean(spark, path, infer_schema=infer)) == [
        (0.0, 172800.5, 1.0, None, 2.0),
        (1.0, 86400.0, None, None, 1.0),
    ]


def test_bad_cell_in_a_number_column(spark, tmp_path):
    path = write(tmp_path, ["a", "1", "oops"])
    assert rows(read_clean(spark, path)) == [(1.0,), (None,)]
    with pytest.raises(Exception, match="not a number in column a: oops"):
        read_clean(spark, path, on_bad_cell="fail").collect()


def test_bad_cell_in_a_declared_column(spark, tmp_path):
    path = write(tmp_path, ["a;b", "1;x", "oops;y"])
    declared = T.StructType().add("a", "integer").add("b", "string")
    assert rows(read_clean(spark, path, schema=declared).select("a")) == [(1.0,), (None,)]
    with pytest.raises(Exception, match="(?i)malformed|bad record"):
        read_clean(spark, path, schema=declared, on_bad_cell="fail").select("a").collect()


def text_file(spark, lines):
    path = shared_folder(spark)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("infer", [True, False])
def test_moved_headers_raise(spark, infer):
    paths = [text_file(spark, ["a;b", "1;2"]), text_file(spark, ["b;a", "3;4"])]
    with pytest.raises(Exception):
        read_delimited(spark, paths, infer_schema=infer).collect()


@pytest.mark.parametrize("infer", [True, False])
@pytest.mark.parametrize("row", ["1;2;99", "3"])
def test_ragged_rows_raise_on_request(spark, infer, row):
    path = text_file(spark, ["a;b", "5;6", row])
    assert read_delimited(spark, path, infer_schema=infer).count() == 2
    with pytest.raises(Exception):
        read_delimited(spark, path, infer_schema=infer, on_bad_cell="fail").collect()
