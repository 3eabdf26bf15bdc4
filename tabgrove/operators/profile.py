"""Types, gaps, bad cells and extremes of text columns from one mergeable aggregate.

Each cell has a kind. The kinds of a column are united bit by bit, and the type of the
column follows from the union, so partial results of any rows can be merged in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgrove.functions.names import quoted, strip_quotes
from tabgrove.operators.clean import number_or_null

# Bits of the kinds of cells, narrow to wide within a family.
INT, LONG, WIDE, DOUBLE, DATE, TIMESTAMP, BOOLEAN, TEXT = (1 << i for i in range(8))
NUMERIC, TEMPORAL = INT | LONG | WIDE | DOUBLE, DATE | TIMESTAMP

# Digits of the widest integer type.
WIDEST = 38

WHOLE = r"^[+-]?\d+$"
DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:"


def cell_kind(cell: Column) -> Column:
    """The bit of the narrowest type that reads the cell; 0 for NULL."""
    whole = cell.rlike(WHOLE)
    return (
        F.when(cell.isNull(), 0)
        .when(whole & cell.try_cast("int").isNotNull(), INT)
        .when(whole & cell.try_cast("bigint").isNotNull(), LONG)
        .when(whole & (_digits(cell) <= WIDEST), WIDE)
        .when(cell.try_cast("double").isNotNull(), DOUBLE)
        .when(cell.rlike(DAY) & cell.try_cast("date").isNotNull(), DATE)
        .when(cell.rlike(MOMENT) & cell.try_cast("timestamp").isNotNull(), TIMESTAMP)
        .when(F.lower(cell).isin("true", "false"), BOOLEAN)
        .otherwise(TEXT)
    )


def _digits(cell: Column) -> Column:
    return F.length(F.regexp_replace(cell, r"^[+-]?0*", ""))


def column_type(kinds: int, digits: int | None) -> T.DataType:
    """The narrowest type that reads every cell of the united ``kinds``.

    Numbers widen from int over bigint and decimal to double, dates to timestamps; two
    families, or no cells at all, make text. ``digits`` is the most of any wide integer,
    where 20 are what a bigint may need.
    """
    if kinds == 0 or kinds & TEXT:
        return T.StringType()
    if kinds & ~NUMERIC == 0:
        if kinds & DOUBLE:
            return T.DoubleType()
        if kinds & WIDE:
            least = 20 if kinds & LONG else 10 if kinds & INT else 0
            return T.DecimalType(max(least, digits or 0), 0)
        return T.LongType() if kinds & LONG else T.IntegerType()
    if kinds & ~TEMPORAL == 0:
        return T.TimestampType() if kinds & TIMESTAMP else T.DateType()
    return T.BooleanType() if kinds == BOOLEAN else T.StringType()


def profile_columns(df: DataFrame) -> DataFrame:
    """``(pos, name, kinds, digits, n_rows, n_null, n_bad, least, greatest, first_text,
    last_text)`` per text column, names without header damage.

    One scan. Cells become rows of (column, cell), so that the code does not grow with the
    columns, and are summed up before the shuffle: one row per task and column is moved.
    ``n_bad`` are cells that ``clean_columns`` would make NULL, ``least`` and ``greatest``
    the extremes of those it reads as numbers, the texts those of all cells by code point.
    """
    other = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.StringType)]
    if other:
        raise ValueError(f"columns are not text: {other}")
    cells = df.select(F.posexplode(F.array(*(F.col(quoted(name)) for name in df.columns))).alias("pos", "cell"))
    cell = F.col("cell")
    cells = cells.select("pos", "cell", cell_kind(cell).alias("kind"), number_or_null(cell).alias("number"))
    number, zero = F.col("number"), F.lit(0).cast("long")
    seen = F.when(~F.isnan(number), number)
    sums = cells.groupBy("pos").agg(
        F.bit_or("kind").alias("kinds"),
        F.max(F.when(F.col("kind") == WIDE, _digits(cell))).alias("digits"),
        F.count("*").alias("n_rows"),
        F.count_if(cell.isNull()).alias("n_null"),
        F.count_if(cell.isNotNull() & number.isNull()).alias("n_bad"),
        F.min(seen).alias("least"),
        F.max(seen).alias("greatest"),
        F.min(cell).alias("first_text"),
        F.max(cell).alias("last_text"),
    )
    names = [(pos, strip_quotes(name)) for pos, name in enumerate(df.columns)]
    columns = df.sparkSession.createDataFrame(names, "pos int, name string")
    counts = {n: F.coalesce(n, zero) for n in ("n_rows", "n_null", "n_bad")}
    rows = F.broadcast(columns).join(sums, "pos", "left").withColumns(counts)
    return rows.withColumns({"pos": F.col("pos").cast("long"), "kinds": F.coalesce("kinds", F.lit(0))})


def profiled_schema(profile: DataFrame) -> T.StructType:
    """The schema that the profile's rows, one for each column, stand for.

    It can be given to ``read_delimited``: types come from the one pass that also counts.
    """
    rows = sorted(profile.select("pos", "name", "kinds", "digits").collect())
    return T.StructType([T.StructField(r["name"], column_type(r["kinds"], r["digits"])) for r in rows])


def profiled_types(profile: DataFrame) -> DataFrame:
    """The profile with the column's ``type`` as text instead of ``kinds`` and ``digits``."""
    wide = F.concat(F.lit("decimal("), F.greatest(_least_digits(), F.coalesce("digits", F.lit(0))), F.lit(",0)"))
    kinds = F.col("kinds")

    def only(family: int) -> Column:
        return kinds.bitwiseAND(F.lit(255 & ~family)) == 0

    def has(bit: int) -> Column:
        return kinds.bitwiseAND(F.lit(bit)) > 0

    choices = [
        ((kinds == 0) | has(TEXT), "string"),
        (only(NUMERIC) & has(DOUBLE), "double"),
        (only(NUMERIC) & has(WIDE), wide),
        (only(NUMERIC) & has(LONG), "bigint"),
        (only(NUMERIC), "int"),
        (only(TEMPORAL) & has(TIMESTAMP), "timestamp"),
        (only(TEMPORAL), "date"),
        (only(BOOLEAN), "boolean"),
    ]
    (first, name), *rest = choices
    named = reduce(lambda done, x: done.when(x[0], x[1]), rest, F.when(first, name)).otherwise("string")
    kept = [c for c in profile.columns if c not in {"pos", "name", "kinds", "digits"}]
    return profile.select("pos", "name", named.alias("type"), *kept)


def _least_digits() -> Column:
    kinds = F.col("kinds")
    return F.when(kinds.bitwiseAND(F.lit(LONG)) > 0, 20).when(kinds.bitwiseAND(F.lit(INT)) > 0, 10).otherwise(0)
