"""Classification metrics, all from one distributed count of (label, prediction) pairs.

The scored table is scanned once. Pairs are counted before the shuffle, so what moves is
at most labels x predictions rows per task, however skewed the labels are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgrove.functions.names import quoted


def confusion_matrix(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``(label, prediction, n)``. A NULL on either side raises: it is neither hit nor miss."""
    pairs = scored.select(
        present(label).alias("label"), present(prediction).alias("prediction")
    )
    return pairs.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def present(name: str) -> Column:
    value = F.col(quoted(name)).cast("double")
    return F.coalesce(value, F.raise_error(F.lit(f"NULL in column {name}")).cast("double"))


def per_label(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(label, n_true, n_predicted, n_hit, precision, recall, f1)`` per label that occurs,
    for each value of the columns ``by``, which come first.

    Every pair counts once for its label and once for its prediction, so one aggregate
    replaces joins of label totals, prediction totals and hits. A label that is never
    predicted has precision and F1 of 0; a prediction that is never a label has no row.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = confusion.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("label"),
                    F.col("n").alias("n_true"),
                    zero.alias("n_predicted"),
                    hit.cast("long").alias("n_hit"),
                ),
                F.struct(
                    F.col("prediction").alias("label"),
                    zero.alias("n_true"),
                    F.col("n").alias("n_predicted"),
                    zero.alias("n_hit"),
                ),
            )
        )
    )
    totals = sides.groupBy(*by, "label").agg(
        F.sum("n_true").alias("n_true"),
        F.sum("n_predicted").alias("n_predicted"),
        F.sum("n_hit").alias("n_hit"),
    )
    has_hits = F.col("n_hit") > 0
    none = F.lit(0.0).cast("double")
    return totals.filter("n_true > 0").select(
        "*",
        F.when(has_hits, F.col("n_hit") / F.col("n_predicted")).otherwise(none).alias("precision"),
        (F.col("n_hit") / F.col("n_true")).alias("recall"),
        F.when(has_hits, 2 * F.col("n_hit") / (F.col("n_true") + F.col("n_predicted")))
        .otherwise(none)
        .alias("f1"),
    )


def summary(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row ``(accuracy, weighted_f1)`` from a ``per_label`` table, NULLs if it is empty;
    or one for each value of the columns ``by``."""
    total = F.sum("n_true")
    return labels.groupBy(*by).agg(
        (F.sum("n_hit") / total).alias("accuracy"),
        (F.sum(F.col("n_true") * F.col("f1")) / total).alias("weighted_f1"),
    )


def accuracy(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row ``(accuracy)``: the share of rows whose prediction is the label."""
    hit = (present(label) == present(prediction)).cast("int")
    return scored.agg(F.avg(hit).alias("accuracy"))


def weighted_f1(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row ``(weighted_f1)``: F1 per label, weighted by how often the label occurs."""
    return summary(per_label(confusion_matrix(scored, label, prediction))).select("weighted_f1")


def metrics_table(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``(metric, value)`` rows for accuracy and weighted F1, from one scan of ``scored``."""
    row = summary(per_label(confusion_matrix(scored, label, prediction)))
    return row.unpivot([], ["accuracy", "weighted_f1"], "metric", "value")
