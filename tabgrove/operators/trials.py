"""Tuning fold by fold: every fit in a durable log, all of a fold's models scored at once.

``tune.cross_validate`` runs Spark's cross-validator, which scores each model by a pass of
its own, keeps one metric, and starts again from nothing if the driver is lost.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgrove.functions.names import quoted
from tabgrove.operators.evaluate import per_label, summary
from tabgrove.operators.folds import FOLD_COL, training_rows, validation_rows
from tabgrove.operators.tune import DEFAULT_GRID, Grid, Tuning, grid_points, param_maps, trials_table
from tabgrove.sources.models import load_model, model_versions, publish_model
from tabgrove.sources.shared import materialise

METRICS = ("accuracy", "weighted_f1")

# The fold number under which the refit on all rows is logged.
ALL_ROWS = -1


@dataclass(frozen=True)
class Trials(Tuning):
    """As ``Tuning``; also ``folds``, one row per point and fold with every metric, and how
    many models were fitted and how many were taken from the log."""

    folds: DataFrame
    n_fitted: int
    n_reused: int


def table_fingerprint(df: DataFrame) -> str:
    """A digest of the rows, as a multiset, and of the columns' names and types; one scan.

    Sums and exclusive ors of row hashes do not depend on the order or layout of rows.
    """
    hashed = F.xxhash64(*(F.col(quoted(name)) for name in df.columns))
    low = hashed.bitwiseAND(F.lit((1 << 31) - 1))
    row = df.agg(F.count("*"), F.bit_xor(hashed), F.sum(low), F.sum(F.shiftrightunsigned(hashed, 33))).collect()[0]
    return _digest([df.dtypes, list(row)])


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def _settings(stage, point: dict[Param, Any] | None = None) -> dict[str, Any]:
    values = {p.name: v for p, v in stage.extractParamMap(point or {}).items()}
    if hasattr(stage, "labels"):
        values["labels"] = stage.labels
    return values


class TrialLog:
    """Fitted models and confusion counts under ``path``, for one table and pipeline.

    A model is keyed by the forest's settings and the fold, so a later run finds it even
    if its grid has other points too. Models are published whole or not at all, and a
    fold's counts are one committed write.
    """

    def __init__(self, spark: SparkSession, path: str, df: DataFrame, pipeline: Pipeline, fold_col: str) -> None:
        *before, forest = pipeline.getStages()
        stages = [[type(s).__name__, _settings(s)] for s in before]
        self.spark, self.forest = spark, forest
        self.path = f"{path.rstrip('/')}/{_digest([table_fingerprint(df), stages, fold_col])[:32]}"

    def key(self, point: dict[Param, Any]) -> str:
        return _digest(_settings(self.forest, point))[:32]

    def _folder(self, point: dict[Param, Any], fold: int) -> str:
        return f"{self.path}/fold_{fold}/{self.key(point)}"

    def find(self, point: dict[Param, Any], fold: int) -> PipelineModel | None:
        folder = self._folder(point, fold)
        return load_model(folder) if model_versions(self.spark, folder) else None

    def keep(self, model: PipelineModel, point: dict[Param, Any], fold: int) -> None:
        publish_model(model, self._folder(point, fold))


def point_counts(models: Sequence[tuple[int, PipelineModel]], rows: DataFrame) -> DataFrame:
    """``(param_id, label, prediction, n)`` of all models over ``rows``, in one scan.

    The models share every stage but the forest. Each adds a column of predictions to the
    same assembled rows; the columns become rows of (point, label, prediction), which are
    counted before they are shuffled: labels x predictions x points rows a task.
    """
    *before, forest = models[0][1].stages
    label = forest.getLabelCol()
    scored = PipelineModel(before).transform(rows)
    columns = []
    for param_id, model in models:
        name = f"prediction_{param_id}"
        last = model.stages[-1].copy().setPredictionCol(name).setRawPredictionCol("").setProbabilityCol("")
        scored = last.transform(scored)
        columns.append(F.struct(F.lit(param_id).cast("long").alias("param_id"), F.col(name).alias("prediction")))
    pairs = scored.select(F.col(quoted(label)).alias("label"), F.explode(F.array(*columns)).alias("point"))
    return pairs.groupBy("point.param_id", "label", "point.prediction").agg(F.count("*").alias("n"))


def fold_metrics(counts: DataFrame) -> DataFrame:
    """``(param_id, fold, accuracy, weighted_f1)`` from counts of all points and folds."""
    by = ["param_id", "fold"]
    return summary(per_label(counts, by), by)


def run_trials(
    df: DataFrame,
    pipeline: Pipeline,
    grid: Grid = DEFAULT_GRID,
    num_folds: int = 2,
    fold_col: str = FOLD_COL,
    metric: str = "accuracy",
    parallelism: int = 1,
    log_path: str | None = None,
) -> Trials:
    """Cross-validate every grid point over the folds in ``fold_col``, then refit the best.

    Gives what ``cross_validate`` gives, with accuracy and weighted F1 of every point and
    fold; ``metric`` names the one that decides. Each fold's training rows are cached,
    spilling to disk, while its models are fitted, ``parallelism`` at a time; then all of
    the fold's models score its validation rows in one scan. The driver holds one fold's
    models at a time.

    With ``log_path``, a folder that outlives the run, every model is published there
    when it is fitted. A run over the same rows, folds and stages takes the models that
    an earlier one has left, whether that ended or not, and fits the others.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    spark, forest = df.sparkSession, pipeline.getStages()[-1]
    points = param_maps(forest, grid)
    check_folds(df, num_folds, fold_col)
    log = TrialLog(spark, log_path, df, pipeline, fold_col) if log_path else None
    done = {"fitted": 0, "reused": 0}

    def fitted(fold: int, rows: DataFrame, param_ids: Sequence[int]) -> list[tuple[int, PipelineModel]]:
        found = {i: log.find(points[i], fold) if log else None for i in param_ids}
        missing = [i for i, model in found.items() if model is None]
        done["reused"] += len(param_ids) - len(missing)

        def fit(i: int) -> None:
            found[i] = fit_point(pipeline, rows, points[i])
            done["fitted"] += 1
            if log:
                log.keep(found[i], points[i], fold)

        if missing:
            rows.persist()
            try:
                with ThreadPool(min(parallelism, len(missing))) as pool:
                    for _ in pool.imap_unordered(inheritable_thread_target(spark)(fit), missing):
                        pass
            finally:
                rows.unpersist()
        return [(i, found[i]) for i in param_ids]

    counts = None
    for fold in range(num_folds):
        models = fitted(fold, training_rows(df, fold, fold_col), range(len(points)))
        own = materialise(point_counts(models, validation_rows(df, fold, fold_col)))
        own = own.withColumn("fold", F.lit(fold).cast("long"))
        counts = own if counts is None else counts.unionByName(own)
    folds = materialise(fold_metrics(counts))

    spread = [
        f(name).alias(f"{kind}_{name}") for name in METRICS for kind, f in (("avg", F.avg), ("std", F.stddev_pop))
    ]
    found = {row["param_id"]: row.asDict() for row in folds.groupBy("param_id").agg(*spread).collect()}
    trials = [{**point, **found[point["param_id"]]} for point in grid_points(forest, grid)]
    best = max(trials, key=lambda trial: trial[f"avg_{metric}"])
    ((_, model),) = fitted(ALL_ROWS, df, [best["param_id"]])
    return Trials(model, trials_table(spark, trials), best, folds, done["fitted"], done["reused"])


def fit_point(pipeline: Pipeline, rows: DataFrame, point: dict[Param, Any]) -> PipelineModel:
    return pipeline.fit(rows, point)


def check_folds(df: DataFrame, num_folds: int, fold_col: str) -> None:
    """Raise unless every row has a fold below ``num_folds`` and every fold has rows."""
    fold = F.col(quoted(fold_col))
    known = df.where(fold.between(0, num_folds - 1)).agg(F.count_distinct(fold)).collect()[0][0]
    odd = df.where(fold.isNull() | ~fold.between(0, num_folds - 1)).limit(1).count()
    if odd or known < num_folds:
        raise ValueError(f"column {fold_col!r} must hold every fold from 0 to {num_folds - 1} and no others")
