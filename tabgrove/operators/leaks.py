"""Features that give the label away, from class histograms of every feature in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.functions.names import quoted
from tabgrove.operators.features import select_features


def class_histograms(df: DataFrame, label: str, features: Sequence[str], digits: int | None = None) -> DataFrame:
    """``(feature, value, label, n)``: rows of each label at each value of each feature.

    One scan: each row becomes one row per feature, counted before it is shuffled, and
    counts of any parts of the table add up. With ``digits`` numbers are rounded first,
    which bounds the histogram of a continuous feature. NULL is a value of its own.
    """
    entries = []
    for name in features:
        value = F.col(quoted(name))
        if digits is not None and dict(df.dtypes)[name] in ("double", "float"):
            value = F.round(value, digits)
        entries.append(F.struct(F.lit(name).alias("feature"), value.cast("string").alias("value")))
    rows = df.select(F.col(quoted(label)).cast("string").alias("label"), F.inline(F.array(*entries)))
    return rows.where("label IS NOT NULL").groupBy("feature", "value", "label").agg(F.count("*").alias("n"))


def leak_report(
    df: DataFrame,
    label: str,
    features: Sequence[str] | None = None,
    digits: int | None = None,
    threshold: float = 0.99,
) -> DataFrame:
    """``(feature, n_values, n_rows, n_decided, n_repeated, n_decided_repeated, share, is_leak)``.

    ``n_decided`` are the rows that a rule which knows one feature only gets right: of
    each value those with its commonest label. A feature without repeated values decides
    every row and tells nothing, so ``n_decided_repeated`` and ``n_repeated`` count values
    that at least two rows hold, ``share`` is their ratio (0 if there are none), and a
    feature whose share reaches ``threshold`` is a leak if most rows are such rows. The
    label may be among the features: it always is a leak. Rows without a label are left
    out; every feature has a row unless no row has a label.
    """
    chosen = select_features(df, label, features, allow_label_feature=True)
    values = (
        class_histograms(df, label, chosen, digits)
        .groupBy("feature", "value")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    )
    several = F.col("n") > 1
    zero = F.lit(0).cast("long")
    report = values.groupBy("feature").agg(
        F.count("*").alias("n_values"),
        F.sum("n").alias("n_rows"),
        F.sum("most").alias("n_decided"),
        F.sum(F.when(several, F.col("n")).otherwise(zero)).alias("n_repeated"),
        F.sum(F.when(several, F.col("most")).otherwise(zero)).alias("n_decided_repeated"),
    )
    share = F.when(F.col("n_repeated") > 0, F.col("n_decided_repeated") / F.col("n_repeated")).otherwise(0.0)
    is_leak = (F.col("share") >= threshold) & (2 * F.col("n_repeated") > F.col("n_rows"))
    return report.withColumn("share", share).withColumn("is_leak", is_leak)
