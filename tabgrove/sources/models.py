"""Fitted pipelines on disk, and the tree nodes of a saved forest as a table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgrove.sources.shared import emptied

VERSIONS, MANIFEST = "versions", "manifest"
MANIFEST_SCHEMA = "sequence long, version string"


def save_model(model: PipelineModel, path: str, overwrite: bool = True) -> None:
    """Save to any filesystem Spark knows; without ``overwrite`` an existing path raises.

    Overwriting removes the old model before the new one is whole; ``publish_model`` does
    not.
    """
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def publish_model(model: PipelineModel, path: str) -> str:
    """Save as a new version under ``path`` and make it the one that ``load_model`` gives.

    The version's folder is written whole before one row is appended to the manifest, and
    Spark commits that row as one file. Whatever fails before leaves the earlier version
    in place; what it wrote is never read. Returns the version's name. Of two writers at
    once the one with the greater name wins, and both stay loadable.
    """
    spark = SparkSession.active()
    published = _published(spark, path)
    sequence = published[0][0] + 1 if published else 1
    version = f"{sequence:08d}-{uuid.uuid4().hex}"
    model.write().save(f"{path}/{VERSIONS}/{version}")
    row = spark.range(0, 1, 1, 1).select(F.lit(sequence).cast("long").alias("sequence"), F.lit(version).alias("version"))
    row.write.mode("append").json(f"{path}/{MANIFEST}")
    return version


def _published(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Sequence and version of all that was published and not retired, the current one
    first; one row for each time a model was published."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = rows.groupBy("version").agg(F.min("sequence").alias("least"), F.max("sequence").alias("sequence"))
    return sorted(((r["sequence"], r["version"]) for r in found.where("least > 0").collect()), reverse=True)


def model_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions, the current one first."""
    return [version for _, version in _published(spark, path)]


def model_folder(spark: SparkSession, path: str) -> str:
    """The folder of the model at ``path``: of its current version if it was published."""
    versions = model_versions(spark, path)
    return f"{path}/{VERSIONS}/{versions[0]}" if versions else path


def load_model(path: str, version: str | None = None) -> PipelineModel:
    """The model saved at ``path``, or the current or a named version published there."""
    folder = f"{path}/{VERSIONS}/{version}" if version else model_folder(SparkSession.active(), path)
    return PipelineModel.load(folder)


def prune_models(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Empty the folders of all but the ``keep`` newest versions; returns their names.

    The manifest only grows: versions retired here are listed again with sequence 0, and
    are emptied after that, so a reader never picks one whose folder is gone.
    """
    if keep < 1:
        raise ValueError("keep at least the current version")
    gone = model_versions(spark, path)[keep:]
    if gone:
        rows = [F.struct(F.lit(0).cast("long").alias("sequence"), F.lit(v).alias("version")) for v in gone]
        retired = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
        retired.write.mode("append").json(f"{path}/{MANIFEST}")
        for version in gone:
            emptied(spark, f"{path}/{VERSIONS}/{version}")
    return gone


def tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per tree node of the forest saved in the pipeline at ``path``.

    A leaf has no children (``left_child`` is -1) and a NULL threshold. The learner
    prunes a split whose leaves all predict the same label, so a root may be a leaf.
    """
    node = F.col("nodeData")
    is_leaf = node["leftChild"] == -1
    folder = model_folder(spark, path)
    return spark.read.parquet(f"{folder}/stages/*_RandomForestClassifier_*/data").select(
        F.col("treeID").cast("long").alias("tree_id"),
        node["id"].cast("long").alias("node_id"),
        node["prediction"].alias("prediction"),
        node["impurity"].alias("impurity"),
        node["rawCount"].alias("n_rows"),
        F.when(~is_leaf, node["gain"]).alias("gain"),
        node["leftChild"].cast("long").alias("left_child"),
        node["rightChild"].cast("long").alias("right_child"),
        F.when(~is_leaf, node["split"]["featureIndex"].cast("long")).alias("feature"),
        F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
    )
