"""Hyper-parameter grid and cross-validated forests; every trial is kept as a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgrove.operators.folds import FOLD_COL

# The default grid, 16 points. The last parameter varies fastest.
DEFAULT_GRID = {
    "maxDepth": [5, 10],
    "numTrees": [50, 150],
    "minInstancesPerNode": [5],
    "seed": [100, 200],
    "impurity": ["entropy", "gini"],
}

Grid = Mapping[str, Sequence[Any]]


def param_maps(forest: RandomForestClassifier, grid: Grid = DEFAULT_GRID) -> list[dict[Param, Any]]:
    """The grid product as Spark parameter maps, in ``param_id`` order."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    return builder.build()


def grid_points(forest: RandomForestClassifier, grid: Grid = DEFAULT_GRID) -> list[dict[str, Any]]:
    """The grid product as plain rows: ``param_id`` and one entry per parameter."""
    return [
        {"param_id": i, **{p.name: p.typeConverter(value) for p, value in point.items()}}
        for i, point in enumerate(param_maps(forest, grid))
    ]


@dataclass(frozen=True)
class Tuning:
    """The winning pipeline refitted on all rows, the ``trials`` table, its winning row."""

    model: PipelineModel
    trials: DataFrame
    best: dict[str, Any]


def cross_validate(
    df: DataFrame,
    pipeline: Pipeline,
    grid: Grid = DEFAULT_GRID,
    num_folds: int = 2,
    fold_col: str = FOLD_COL,
    metric: str = "accuracy",
    parallelism: int = 1,
) -> Tuning:
    """Cross-validate every grid point over the folds in ``fold_col``, then refit the best.

    ``pipeline`` ends with the forest. Its label dictionary should be a fitted stage: one
    fitted per fold would not know a label that the fold's training rows lack.

    ``df`` should be narrow and cheap to scan, as it is read for every fold. Each fold's
    rows are cached, spilling to disk, as the plain columns of ``df`` while its trials
    run. ``parallelism`` trials run at once; each keeps its own binned copy of the rows.
    """
    forest = pipeline.getStages()[-1]
    evaluator = MulticlassClassificationEvaluator(
        labelCol=forest.getLabelCol(),
        predictionCol=forest.getPredictionCol(),
        metricName=metric,
    )
    fitted = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=param_maps(forest, grid),
        evaluator=evaluator,
        numFolds=num_folds,
        foldCol=fold_col,
        parallelism=parallelism,
    ).fit(df)
    trials = [
        {**point, "avg_metric": float(avg), "std_metric": float(std)}
        for point, avg, std in zip(
            grid_points(forest, grid), fitted.avgMetrics, fitted.stdMetrics
        )
    ]
    # Of equal points both min and max return the first, as the refit does.
    pick = max if evaluator.isLargerBetter() else min
    best = pick(trials, key=lambda trial: trial["avg_metric"])
    return Tuning(fitted.bestModel, trials_table(df.sparkSession, trials), best)


def best_trial(trials: DataFrame, larger_is_better: bool = True) -> DataFrame:
    """The winning row of a trials table; the first point wins a tie."""
    metric = F.desc("avg_metric") if larger_is_better else F.asc("avg_metric")
    return trials.orderBy(metric, F.asc("param_id")).limit(1)


def trials_table(spark: SparkSession, trials: list[dict[str, Any]]) -> DataFrame:
    """One row per grid point; the grid is an argument, so this is never large."""
    types = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    schema = T.StructType([T.StructField(k, types[type(v)]) for k, v in trials[0].items()])
    return spark.createDataFrame([tuple(trial.values()) for trial in trials], schema)
