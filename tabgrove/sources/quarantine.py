"""Delimited text whose bad rows are kept apart, with where they stand and what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgrove.functions.names import check_distinct, quoted, strip_quotes
from tabgrove.operators.clean import number_or_null

BAD = "bad"
IS_BAD = "is_bad"

# A quoted cell, inside which the separator does not count; the escape is Spark's default.
QUOTED_CELL = r'"(?:[^"\\]|\\.)*"'

BAD_TYPE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
    ]
)


def read_checked(
    spark: SparkSession, path: str | list[str], sep: str = ";", text_columns: Sequence[str] = ()
) -> DataFrame:
    """Clean columns as ``clean_columns`` gives them, and ``bad``: NULL for a good row.

    One scan of the text. A row is bad if it has too many or too few cells, or a cell that
    is neither empty nor a number; columns in ``text_columns`` (names without header
    damage) stay text and take any cell. ``bad`` holds the ``file``, the start of the
    block of the file that was read (``block_start``), a ``place`` that grows with the
    rows of one read, the raw ``line`` (of a row with a wrong number of cells, else its
    cells joined by the separator) and the ``reasons``, each naming what it is about. The
    numbers of a bad row are what could be read of it.

    The header of every file is checked. Line breaks within cells are not read.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False)
    header = reader.csv(path).columns
    names = [strip_quotes(name) for name in header]
    check_distinct(spark, [*names, BAD])
    unknown = sorted(set(text_columns) - set(names))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    corrupt = "corrupt"
    while corrupt.lower() in (name.lower() for name in header):
        corrupt += "_"
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*header, corrupt]])
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    raw = raw.schema(schema).csv(path)

    line = F.col(quoted(corrupt))
    values, reasons = [], [_width_reason(line, sep, len(header))]
    for name, clean in zip(header, names):
        cell = F.col(quoted(name))
        if clean in text_columns:
            values.append(cell.alias(clean))
            continue
        number = number_or_null(cell)
        values.append(number.alias(clean))
        wrong = F.concat(F.lit(f"not a number in column {clean}: "), cell)
        reasons.append(F.when(cell.isNotNull() & number.isNull(), wrong))
    told = F.array_compact(F.array(*reasons))
    joined = F.concat_ws(sep, *(F.coalesce(F.col(quoted(n)), F.lit("")) for n in header))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"),
        F.coalesce(line, joined).alias("line"),
        told.alias("reasons"),
    )
    return raw.select(*values, F.when(F.size(told) > 0, place).alias(BAD))


def _width_reason(line: Column, sep: str, width: int) -> Column:
    """Spark keeps the raw line of a row whose number of cells differs from the header's."""
    bare = F.regexp_replace(line, QUOTED_CELL, "")
    cells = (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1
    told = F.concat(cells.cast("int").cast("string"), F.lit(f" cells instead of {width}"))
    return F.when(line.isNotNull(), told)


def write_split(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write good and bad rows apart under ``path`` in one job, and return scans of both.

    The text is read once: rows go to one of two partitions of one Parquet table. The
    first scan has the clean columns; the second the fields of ``bad``.
    """
    columns = [name for name in checked.columns if name != BAD]
    marked = checked.withColumn(IS_BAD, F.col(BAD).isNotNull())
    marked.write.partitionBy(IS_BAD).parquet(path)
    schema = T.StructType([*checked.schema.fields, T.StructField(IS_BAD, T.BooleanType())])
    table = checked.sparkSession.read.schema(schema).parquet(path)
    good = table.where(~F.col(IS_BAD)).select(*map(quoted, columns))
    return good, table.where(IS_BAD).select(f"{BAD}.*")


def reason_counts(bad: DataFrame) -> DataFrame:
    """``(file, reason, n)``: bad rows of each file by what is wrong, without the cells."""
    each = bad.select("file", F.explode("reasons").alias("reason"))
    kind = F.regexp_extract("reason", r"^(not a number in column .*?): ", 1)
    reason = F.when(kind != "", kind).otherwise(F.col("reason"))
    return each.groupBy("file", reason.alias("reason")).agg(F.count("*").alias("n"))
