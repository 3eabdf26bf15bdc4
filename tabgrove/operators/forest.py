"""Random forest estimator and the pipeline around it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame

from tabgrove.functions.names import quoted
from tabgrove.operators.features import build_assembler, select_features
from tabgrove.operators.labels import fit_label_index

# The default forest.
DEFAULT_FOREST = {
    "numTrees": 150,
    "maxDepth": 15,
    "seed": 150,
    "impurity": "gini",
}


def build_forest(**params) -> RandomForestClassifier:
    """A forest over ``features`` and ``label``; ``params`` are Spark's own parameter names."""
    settings = {"featuresCol": "features", "labelCol": "label", **DEFAULT_FOREST, **params}
    return RandomForestClassifier(**settings)


def check_added_names(inputs: Iterable[str], forest: RandomForestClassifier) -> None:
    """Raise if an input column is named like one that the pipeline adds.

    Give the forest another name for its own column then: ``build_forest(labelCol="y")``.
    """
    added = {
        forest.getFeaturesCol(),
        forest.getLabelCol(),
        forest.getRawPredictionCol(),
        forest.getProbabilityCol(),
        forest.getPredictionCol(),
    }
    taken = {name.lower() for name in inputs}
    clash = sorted(name for name in added if name.lower() in taken)
    if clash:
        raise ValueError(f"input columns are named like output columns: {clash}")


def build_pipeline(
    assembler: VectorAssembler, indexer: StringIndexerModel, classifier: RandomForestClassifier
) -> Pipeline:
    """Assembly, label index and forest in one pipeline."""
    return Pipeline(stages=[assembler, indexer, classifier])


def fit_pipeline(
    df: DataFrame,
    label: str,
    forest: RandomForestClassifier,
    features: Sequence[str] | None = None,
    allow_label_feature: bool = False,
    handle_invalid: str = "error",
    max_labels: int | None = None,
    cache: bool = True,
) -> PipelineModel:
    """Fit dictionary and forest on ``df`` without tuning.

    The rows are read once for the dictionary and three times by the forest, so the
    columns in use are cached meanwhile, spilling to disk. Switch that off for a ``df``
    that is cached already, or where disks cannot hold those columns.
    """
    chosen = select_features(df, label, features, allow_label_feature)
    check_added_names([*chosen, label], forest)
    rows = df.select(*(quoted(name) for name in dict.fromkeys([*chosen, label])))
    if cache:
        rows.persist()
    try:
        assembler = build_assembler(chosen, forest.getFeaturesCol(), handle_invalid)
        indexer = fit_label_index(rows, label, forest.getLabelCol(), handle_invalid, max_labels)
        return build_pipeline(assembler, indexer, forest).fit(rows)
    finally:
        if cache:
            rows.unpersist()
