"""Labels and their indexes by joins with the label table, for dictionaries of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgrove.functions.names import check_distinct, quoted

# A label table up to this size goes whole to every executor; a larger one is joined by a
# shuffle. Bytes of the labels' text plus what a row of it costs in memory.
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64


def table_bytes(labels: DataFrame) -> int:
    """The size that decides how a label table is joined, counted over all its rows."""
    text = F.coalesce(F.sum(F.octet_length("label")), F.lit(0))
    return labels.agg((text + F.count("*") * ROW_BYTES).alias("size")).collect()[0]["size"]


def with_index(
    df: DataFrame, label: str, labels: DataFrame, output: str = "label", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with the index of its column ``label`` as ``output``, from ``labels(label, idx)``.

    Labels are compared as text, as the dictionary holds them. An unknown or NULL label
    has no index; every row stays. The table is broadcast only if all of it was counted
    to be at most ``broadcast_bytes``; else both sides are shuffled, and where one label
    holds many of the rows Spark splits its partition (adaptive skew join).
    """
    check_distinct(df.sparkSession, [*df.columns, output])
    found = labels.select(F.col("label").alias("_label"), F.col("idx").alias(output))
    return _joined(df, F.col(quoted(label)).cast("string"), found, "_label", labels, broadcast_bytes)


def with_label(
    df: DataFrame, index: str, labels: DataFrame, output: str = "predicted", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with the label of its column ``index`` as ``output``; the way back.

    An index that the table lacks, or NULL, has no label; every row stays.
    """
    check_distinct(df.sparkSession, [*df.columns, output])
    found = labels.select(F.col("idx").cast("double").alias("_idx"), F.col("label").alias(output))
    return _joined(df, F.col(quoted(index)).cast("double"), found, "_idx", labels, broadcast_bytes)


def _joined(
    df: DataFrame, value, found: DataFrame, name: str, labels: DataFrame, broadcast_bytes: int
) -> DataFrame:
    small = table_bytes(labels) <= broadcast_bytes
    side = found.hint("broadcast") if small else found.hint("merge")
    return df.withColumn("_value", value).join(side, F.col("_value") == F.col(name), "left").drop("_value", name)


def dictionary_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    """``(label, idx)`` of a fitted dictionary, which the driver holds as part of the model."""
    rows = [(label, float(i)) for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "label string, idx double")
