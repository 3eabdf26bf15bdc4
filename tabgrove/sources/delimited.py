"""Delimited text with a header row whose names may be damaged by extra quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabgrove.functions.names import strip_quotes


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ";",
    infer_schema: bool = True,
    schema: T.StructType | None = None,
    on_bad_cell: str = "null",
) -> DataFrame:
    """Read delimited text from any filesystem Spark knows; the header gives the names.

    ``infer_schema=True`` reads every byte once more to find the types. For large
    inputs pass ``schema``, or ``infer_schema=False`` to get strings, which
    ``clean_columns`` casts in the same scan that uses them.

    The header of every file is checked against the names, so a moved or missing column
    raises. A given ``schema`` names its columns without header damage. A cell that does
    not fit its declared type becomes NULL; a row with too few cells gets NULLs and one
    with too many loses the rest, where the header has no names for them. With
    ``on_bad_cell="fail"`` all three raise.
    """
    mode = "FAILFAST" if on_bad_cell == "fail" else "PERMISSIVE"
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.option("enforceSchema", False).option("mode", mode)
    if schema is None:
        return reader.option("inferSchema", infer_schema).csv(path)

    header = reader.csv(path).columns
    found = [strip_quotes(name) for name in header]
    wanted = [strip_quotes(name) for name in schema.fieldNames()]
    if found != wanted:
        raise ValueError(f"header holds {found}, the schema names {wanted}")
    raw = T.StructType(
        [T.StructField(name, field.dataType) for name, field in zip(header, schema.fields)]
    )
    return reader.schema(raw).csv(path)


def inferred_types(df: DataFrame) -> DataFrame:
    """``(pos, name, type)`` per column of a scan, names without header damage."""
    rows = [
        (pos, strip_quotes(field.name), field.dataType.simpleString())
        for pos, field in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "pos long, name string, type string")
