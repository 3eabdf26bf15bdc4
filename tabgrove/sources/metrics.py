"""A table of metrics to which a job that is run again does not write twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("model", "batch")
SCHEMA = "metric string, value double, model string, batch string"


def write_metrics(metrics: DataFrame, path: str, model: str, batch: str) -> None:
    """Replace the metrics of one model and batch in the table at ``path``.

    ``metrics`` has the columns ``(metric, value)``. The table is partitioned by model and
    batch, and only the partition that is written is overwritten, by one commit: a retried
    job leaves one row for each metric, and others' rows stay.
    """
    if not model or not batch:
        raise ValueError("model and batch name the rows and must not be empty")
    rows = metrics.select("metric", F.col("value").cast("double").alias("value"))
    rows = rows.withColumns({"model": F.lit(model), "batch": F.lit(batch)})
    writer = rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*KEYS).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, value, model, batch)`` of all models and batches; no rows before the
    first write."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
