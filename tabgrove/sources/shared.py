"""Working tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tabgrove.functions.names import quoted

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folder: tempfile.TemporaryDirectory | None = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, or else under the context's own
    checkpoint directory.

    Only a local session may go without either; it gets a temporary folder. On a
    cluster that would be a different folder on every machine, so it raises there.
    """
    global _local_folder
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_folder is None:
            _local_folder = tempfile.TemporaryDirectory(prefix="tabgrove-")
        base = _local_folder.name
    return f"{base.rstrip('/')}/tabgrove-{uuid.uuid4().hex}"


def lay_out(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` over a stated number of partitions, or as it is for None.

    For input that does not split, such as one compressed text file or one row group:
    training reads its rows dozens of times. Rows are dealt round robin, so that equal
    rows are no hot key. Shuffled blocks arrive in any order, and a bootstrap depends on
    the order of rows, so each partition is sorted: one scan gives the same partitions
    every time, whatever the number of cores.
    """
    if partitions is None:
        return df
    return df.repartition(partitions).sortWithinPartitions(*map(quoted, df.columns))


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return a scan of it.

    Cuts the lineage: a lost executor costs a re-read of its splits, not a re-parse of
    the source, and random columns keep the values that were written. Column metadata
    (ML attributes) is kept. ``partitions`` states the layout, see ``lay_out``.

    The table stays, as checkpoints do; ``materialised`` removes it.
    """
    return written(lay_out(df, partitions))[0]


@contextmanager
def materialised(df: DataFrame, partitions: int | None = None) -> Iterator[DataFrame]:
    """``materialise`` for the length of a ``with`` block; the rows are deleted after it."""
    scan, path = written(lay_out(df, partitions))
    try:
        yield scan
    finally:
        emptied(scan.sparkSession, path)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``materialise``, with the table's place, which the caller may empty."""
    spark = df.sparkSession
    path = shared_folder(spark)
    # A written table needs the shuffle files of its query no more; the driver would keep
    # them until it happens to collect garbage.
    with settings(spark, {_CLEANUP: True}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for the length of a ``with`` block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def emptied(spark: SparkSession, path: str) -> None:
    """Replace all that lies at ``path`` by a table without rows, with Spark's own writer
    on any filesystem."""
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
