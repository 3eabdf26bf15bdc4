"""Uniform numeric tables out of raw scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgrove.functions.names import check_distinct, quoted, strip_quotes

# A date followed by a time, in the session's zone unless it names one.
DATE_AND_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:"


def clean_columns(df: DataFrame, on_bad_cell: str = "null") -> DataFrame:
    """Strip quotes around every name and cast every column to double, in one projection.

    ``on_bad_cell``: a cell that is not a number becomes NULL (``"null"``) or raises
    (``"fail"``). NULL cells stay NULL either way. Two names that become equal raise.

    Booleans are 1 and 0, timestamps seconds since 1970, dates without a time no numbers,
    whether they come with that type or as text, cell by cell: a scan of text gives what
    one with inferred types does. Only inference over a column of both dates and
    timestamps differs, as it makes the dates timestamps.
    """
    if on_bad_cell not in ("null", "fail"):
        raise ValueError(f"on_bad_cell must be 'null' or 'fail', not {on_bad_cell!r}")
    check_distinct(df.sparkSession, [strip_quotes(name) for name in df.columns])
    return df.select(
        *(
            _number(field, on_bad_cell).alias(strip_quotes(field.name))
            for field in df.schema.fields
        )
    )


def _number(field: T.StructField, on_bad_cell: str) -> Column:
    cell = F.col(quoted(field.name))
    if isinstance(field.dataType, T.DateType):
        # Spark has no cast from date to double; schema inference can yield dates.
        number = F.lit(None).cast("double")
    elif isinstance(field.dataType, T.StringType):
        number = number_or_null(cell)
    else:
        number = cell.try_cast("double")
    if on_bad_cell == "null" or isinstance(field.dataType, T.NumericType):
        return number
    message = F.concat(F.lit(f"not a number in column {field.name}: "), cell.cast("string"))
    return F.when(cell.isNotNull() & number.isNull(), F.raise_error(message)).otherwise(number)


def number_or_null(cell: Column) -> Column:
    """The number that a cell of text stands for, or NULL."""
    return F.coalesce(cell.try_cast("double"), _truth(cell), _moment(cell))


def _truth(cell: Column) -> Column:
    return F.when(F.lower(cell) == "true", 1.0).when(F.lower(cell) == "false", 0.0)


def _moment(cell: Column) -> Column:
    """Seconds since 1970 of a date with a time; a date alone is no number."""
    return F.when(cell.rlike(DATE_AND_TIME), cell.try_cast("timestamp").cast("double"))
