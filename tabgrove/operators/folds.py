"""Assigning rows to cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.functions.names import quoted
from tabgrove.operators.number import number_rows

FOLD_COL = "cv_fold"


def assign_folds(
    df: DataFrame,
    num_folds: int = 2,
    seed: int = 0,
    keys: Sequence[str] | None = None,
    fold_col: str = FOLD_COL,
) -> DataFrame:
    """Add ``fold_col`` with values 0 to ``num_folds`` - 1; no shuffle.

    With ``keys`` the fold is a hash of the key values: it depends on nothing but the
    row, and rows that share a key share a fold. Without, it is drawn per row and
    depends on how the rows are partitioned: write the result before using it twice.
    """
    if num_folds < 2:
        raise ValueError("num_folds must be at least 2")
    if fold_col.lower() in (name.lower() for name in df.columns):
        raise ValueError(f"column {fold_col!r} exists already")
    if keys:
        fold = F.pmod(F.xxhash64(F.lit(seed), *(F.col(quoted(k)) for k in keys)), F.lit(num_folds))
    else:
        fold = F.floor(F.rand(seed) * num_folds)
    return df.withColumn(fold_col, fold.cast("int"))


def assign_stratified_folds(
    df: DataFrame, label: str, num_folds: int = 2, seed: int = 0, fold_col: str = FOLD_COL
) -> DataFrame:
    """Add ``fold_col`` so that each label's rows are spread over the folds in parts that
    are at most one row apart, and so are the folds as wholes.

    All rows are numbered by (label, a draw with ``seed``) and dealt to the folds in turn.
    A label's rows follow each other in that order, so its parts are as equal as can be,
    however rare or common it is; NULL and NaN are labels of their own. Ranges number
    their rows, so no label is gathered. The result is a table in the shared folder: the
    draw is pinned.
    """
    if num_folds < 2:
        raise ValueError("num_folds must be at least 2")
    if fold_col.lower() in (name.lower() for name in df.columns):
        raise ValueError(f"column {fold_col!r} exists already")
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    rows = number_rows(drawn, [F.col(quoted(label)).asc_nulls_first(), F.col("_draw").asc()], "_number")
    fold = F.pmod("_number", F.lit(num_folds)).cast("int")
    return rows.withColumn(fold_col, fold).drop("_draw", "_number")


def fold_counts(df: DataFrame, label: str, fold_col: str = FOLD_COL) -> DataFrame:
    """``(fold, label, n)``: how the labels are spread over the folds."""
    return df.groupBy(
        F.col(quoted(fold_col)).alias("fold"), F.col(quoted(label)).alias("label")
    ).agg(F.count("*").alias("n"))


def training_rows(df: DataFrame, fold: int, fold_col: str = FOLD_COL) -> DataFrame:
    return df.filter(F.col(quoted(fold_col)) != fold)


def validation_rows(df: DataFrame, fold: int, fold_col: str = FOLD_COL) -> DataFrame:
    return df.filter(F.col(quoted(fold_col)) == fold)
