"""Error bars for metrics: a Poisson bootstrap in the scan that counts the pairs."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.functions.names import quoted
from tabgrove.operators.evaluate import per_label, present, summary

# Hash digits of one draw, and how many of them an md5 holds.
DRAW_DIGITS, DRAWS = 8, 4


def poisson_limits() -> list[int]:
    """Draws of 32 bits from which on a Poisson(1) variable is more than 0, 1, 2, ..."""
    limits, total, term = [], 0.0, exp(-1)
    for k in range(1, 14):
        total += term
        term /= k
        limits.append(round(total * 16**DRAW_DIGITS))
    return [x for x in limits if x < 16**DRAW_DIGITS]


def with_replicates(df: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Each row of ``df`` once for each replicate it counts in, with ``replicate`` and
    ``weight``: 1 in replicate 0, else drawn from Poisson(1).

    Draws are digits of the md5 of seed, number of four replicates, and the keys as text
    joined by ``|`` (NULL empty): they depend on nothing but the row's keys, so a rerun or
    a retried task repeats them, and any engine can. Rows stay where they are.
    """
    key = F.concat_ws("|", *(F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in keys))
    last = max(0, -(-replicates // DRAWS) - 1)
    rows = df.withColumn("_key", key).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_block").cast("string"), F.lit(":"), F.col("_key")))
    draws = [
        F.conv(F.substring(digest, at * DRAW_DIGITS + 1, DRAW_DIGITS), 16, 10).cast("long") for at in range(DRAWS)
    ]
    # The rows themselves: a draw of 1, behind those of the first four replicates.
    itself = F.lit(poisson_limits()[0]).cast("long")
    every = F.when(F.col("_block") == 0, F.array(*draws, itself)).otherwise(F.array(*draws))
    rows = rows.select("*", F.posexplode(every).alias("_at", "_draw"))
    replicate = F.when(F.col("_at") < DRAWS, F.col("_block") * DRAWS + F.col("_at") + 1).otherwise(0)
    weight = sum(((F.col("_draw") >= limit).cast("long") for limit in poisson_limits()), F.lit(0).cast("long"))
    rows = rows.withColumn("replicate", replicate.cast("long")).withColumn("weight", weight)
    return rows.where((F.col("replicate") <= replicates) & (F.col("weight") > 0)).drop("_key", "_block", "_at", "_draw")


def bootstrap_confusion(
    scored: DataFrame,
    keys: Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    replicates: int = 100,
    seed: int = 0,
) -> DataFrame:
    """``(replicate, label, prediction, n)``: the confusion matrix as replicate 0, and one
    for each bootstrap replicate, from one scan.

    Every row counts in every replicate as often as its keys' hash says, about once: no
    row is drawn from a list, so the table may be of any size. Sums are formed before the
    shuffle, which moves labels x predictions x replicates rows a task at most. Rows that
    share their keys are drawn together, as clusters are.
    """
    key_names = [f"_k{i}" for i in range(len(keys))]
    pairs = scored.select(
        present(label).alias("label"),
        present(prediction).alias("prediction"),
        *(F.col(quoted(k)).alias(name) for k, name in zip(keys, key_names)),
    )
    counts = with_replicates(pairs, key_names, replicates, seed).groupBy("replicate", "label", "prediction")
    return counts.agg(F.sum("weight").alias("n"))


def metric_intervals(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """``(metric, value, std, low, high, n_replicates)`` for accuracy and weighted F1.

    ``value`` is that of the rows themselves, ``std`` the deviation and ``low`` and
    ``high`` the exact middle ``level`` of the replicates, which are few numbers.
    """
    values = summary(per_label(counts, ["replicate"]), ["replicate"])
    long = values.unpivot("replicate", ["accuracy", "weighted_f1"], "metric", "value")
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    tail = (1 - level) / 2
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("value"),
        F.stddev(drawn).alias("std"),
        F.percentile(drawn, F.lit(tail)).alias("low"),
        F.percentile(drawn, F.lit(1 - tail)).alias("high"),
        F.count(drawn).alias("n_replicates"),
    )
