"""Label dictionary: labels ranked by frequency, index 0 for the most frequent."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgrove.functions.names import ml_name, quoted
from tabgrove.sources.shared import materialise

# Spark's monotonically_increasing_id: the partition above these bits, the row below.
ROW_BITS = 33


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, n)`` with labels as text. NULL and NaN labels are not counted."""
    return (
        df.select(F.col(quoted(label)).alias("label"))
        .na.drop()
        .groupBy(F.col("label").cast("string").alias("label"))
        .agg(F.count("*").alias("n"))
    )


def label_table(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, idx)`` of every label: most frequent first, ties by ascending text.

    Rows are counted before they are shuffled, so a dominant label costs one row per
    task. The counts are dealt into ranges of the order, written once in the shared
    folder, and each range numbers its labels after those of the ranges before it.
    """
    order = [F.desc("n"), F.asc("label")]
    dealt = label_counts(df, label).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(dealt.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", ROW_BITS))
    ranges = rows.groupBy("range").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    # One row for each range, whose number is that of tasks, not of labels.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    idx = F.col("at") - F.col("first") + F.col("before")
    return rows.join(ranges, "range").select("label", "n", idx.cast("double").alias("idx"))


def fit_label_index(
    df: DataFrame,
    label: str,
    output: str = "label",
    handle_invalid: str = "error",
    max_labels: int | None = None,
) -> StringIndexerModel:
    """Fit the dictionary over all rows once; the result is a stage of every pipeline.

    Fitted before the folds, so that a label which a training fold happens to lack is
    still known. ``handle_invalid`` says what an unseen or NULL label does at transform.

    The dictionary is part of the model, so the driver holds it. ``max_labels`` refuses a
    column with more labels before they are collected; without it Spark's own
    ``spark.driver.maxResultSize`` guards the driver. Nothing is cut off.
    """
    labels = label_table(df, label)
    if max_labels is not None and labels.count() > max_labels:
        raise ValueError(f"column {label!r} holds more than {max_labels} labels")
    rows = labels.collect()
    if not rows:
        raise ValueError(f"column {label!r} holds no labels")
    return StringIndexerModel.from_labels(
        [row["label"] for row in sorted(rows, key=lambda row: row["idx"])],
        inputCol=ml_name(label),
        outputCol=output,
        handleInvalid=handle_invalid,
    )


def apply_label_index(df: DataFrame, model: StringIndexerModel) -> DataFrame:
    """Add the index column. An unseen or NULL label raises unless the model says otherwise."""
    return model.transform(df)
