"""Train from a path, score a path: the two jobs built from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgrove.functions.names import quoted
from tabgrove.operators.bootstrap import bootstrap_confusion, metric_intervals
from tabgrove.operators.clean import clean_columns
from tabgrove.operators.evaluate import metrics_table
from tabgrove.operators.features import build_assembler, select_features
from tabgrove.operators.folds import FOLD_COL, assign_folds, assign_stratified_folds
from tabgrove.operators.forest import build_forest, build_pipeline, check_added_names
from tabgrove.operators.labels import fit_label_index
from tabgrove.operators.leaks import leak_report
from tabgrove.operators.profile import profile_columns, profiled_schema, profiled_types
from tabgrove.operators.score import pipeline_forest, score_batch
from tabgrove.operators.trials import run_trials
from tabgrove.operators.tune import DEFAULT_GRID, Grid, Tuning, cross_validate
from tabgrove.sources.delimited import read_delimited
from tabgrove.sources.metrics import write_metrics
from tabgrove.sources.models import load_model, publish_model, save_model
from tabgrove.sources.quarantine import read_checked, write_split
from tabgrove.sources.shared import materialised


def read_clean(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ";",
    infer_schema: bool = False,
    schema: T.StructType | None = None,
    on_bad_cell: str = "null",
    quarantine_path: str | None = None,
) -> DataFrame:
    """Read delimited text and clean it.

    Cells are cast where they are read, so every byte is read once. ``infer_schema=True``
    finds the types by one more pass; the rows are the same, see ``clean_columns``.

    With ``quarantine_path`` only rows without fault go on. All rows are written there,
    good and bad ones apart with what is wrong, by the one scan (see ``write_split``).
    """
    if quarantine_path:
        if infer_schema or schema is not None or on_bad_cell != "null":
            raise ValueError("quarantine_path reads text cell by cell and takes no other reading option")
        return write_split(read_checked(spark, path, sep), quarantine_path)[0]
    raw = read_delimited(spark, path, sep, infer_schema, schema, on_bad_cell)
    return clean_columns(raw, on_bad_cell)


def train_classifier(
    df: DataFrame,
    label: str,
    features: Sequence[str] | None = None,
    allow_label_feature: bool = False,
    forest: RandomForestClassifier | None = None,
    grid: Grid = DEFAULT_GRID,
    num_folds: int = 2,
    seed: int = 0,
    fold_keys: Sequence[str] | None = None,
    fold_col: str | None = None,
    metric: str = "accuracy",
    parallelism: int = 1,
    handle_invalid: str = "error",
    max_labels: int | None = None,
    one_scan: bool = False,
    trial_log: str | None = None,
    stratified: bool = False,
    leak_threshold: float | None = None,
) -> Tuning:
    """Tune a forest on a clean table by cross-validation and refit the winner.

    ``one_scan`` scores all models of a fold in one pass and returns every metric of every
    trial; ``trial_log`` names a folder where a run that was stopped is taken up again.
    Both go by ``trials.run_trials``, whose ``metric`` is accuracy or weighted_f1.

    ``stratified`` draws folds that each label is spread over evenly. With
    ``leak_threshold`` a feature that alone decides that share of the labels raises before
    anything is fitted (see ``leak_report``), at the cost of one scan.

    By default every column but the label and those that only name folds is a feature.

    The source is scanned once: the columns in use and the fold are written as a table
    that the label dictionary, all trials and the refit read. Folds come from the integer
    column ``fold_col``, or a hash of ``fold_keys``, or a draw with ``seed``.
    """
    if features is None:
        apart = {label, fold_col, *(fold_keys or [])}
        features = [name for name in df.columns if name not in apart]
    chosen = select_features(df, label, features, allow_label_feature)
    forest = forest or build_forest()
    check_added_names([*chosen, label], forest)
    used = [F.col(quoted(name)) for name in dict.fromkeys([*chosen, label])]
    if stratified and (fold_col or fold_keys):
        raise ValueError("stratified folds are drawn; fold_col and fold_keys name others")
    if stratified:
        table = assign_stratified_folds(df.select(*used), label, num_folds, seed)
    elif fold_col:
        table = df.select(*used, F.col(quoted(fold_col)).cast("int").alias(FOLD_COL))
    else:
        table = assign_folds(df, num_folds, seed, fold_keys).select(*used, FOLD_COL)
    assembler = build_assembler(chosen, forest.getFeaturesCol(), handle_invalid)

    with materialised(table) as rows:
        if leak_threshold is not None:
            refuse_leaks(rows, label, [c for c in chosen if c != label], leak_threshold)
        indexer = fit_label_index(rows, label, forest.getLabelCol(), handle_invalid, max_labels)
        pipeline = build_pipeline(assembler, indexer, forest)
        if one_scan or trial_log:
            return run_trials(rows, pipeline, grid, num_folds, FOLD_COL, metric, parallelism, trial_log)
        return cross_validate(rows, pipeline, grid, num_folds, FOLD_COL, metric, parallelism)


def refuse_leaks(df: DataFrame, label: str, features: Sequence[str], threshold: float) -> None:
    """Raise if a feature alone decides ``threshold`` of the labels, and name all that do."""
    report = leak_report(df, label, features, threshold=threshold)
    found = sorted(row["feature"] for row in report.where("is_leak").collect())
    if found:
        raise ValueError(f"features that decide the label {label!r} alone: {found}")


def profile_job(spark: SparkSession, path: str | list[str], sep: str = ";") -> tuple[DataFrame, T.StructType]:
    """The profile of a path's columns, one row each, and the schema that it stands for.

    One pass over the text. The schema can be given to the other jobs, which then read
    with types, without another pass to find them.
    """
    profile = profile_columns(read_delimited(spark, path, sep, infer_schema=False))
    rows = spark.createDataFrame(profile.collect(), profile.schema)
    return profiled_types(rows), profiled_schema(rows)


def train_job(
    spark: SparkSession,
    input_path: str | list[str],
    model_path: str,
    label: str,
    sep: str = ";",
    infer_schema: bool = False,
    schema: T.StructType | None = None,
    on_bad_cell: str = "null",
    quarantine_path: str | None = None,
    versioned: bool = False,
    **training,
) -> Tuning:
    """Read, clean, tune, refit, save. ``training`` goes to ``train_classifier``.

    ``versioned`` publishes the model beside earlier ones, which stay loadable whatever
    fails; without it the model is a plain Spark folder that replaces what was there.
    """
    table = read_clean(spark, input_path, sep, infer_schema, schema, on_bad_cell, quarantine_path)
    trained = train_classifier(table, label, **training)
    (publish_model if versioned else save_model)(trained.model, model_path)
    return trained


def score_job(
    spark: SparkSession,
    input_path: str | list[str],
    model_path: str,
    sep: str = ";",
    infer_schema: bool = False,
    schema: T.StructType | None = None,
    on_bad_cell: str = "null",
    quarantine_path: str | None = None,
) -> DataFrame:
    """Read, clean and score a path with a saved model; lazy, one scan."""
    table = read_clean(spark, input_path, sep, infer_schema, schema, on_bad_cell, quarantine_path)
    return score_batch(load_model(model_path), table)


def evaluate_job(
    spark: SparkSession,
    input_path: str | list[str],
    model_path: str,
    sep: str = ";",
    infer_schema: bool = False,
    schema: T.StructType | None = None,
    on_bad_cell: str = "null",
    quarantine_path: str | None = None,
    metrics_path: str | None = None,
    batch: str | None = None,
    replicates: int = 0,
    row_keys: Sequence[str] | None = None,
    level: float = 0.95,
) -> DataFrame:
    """Score a labelled path and return its ``(metric, value)`` table.

    With ``replicates`` the table also has deviation and interval of each metric (``std,
    low, high, n_replicates``), from bootstrap weights that the same scan draws by
    ``row_keys``, columns that together name a row.

    With ``metrics_path`` the rows are also put into the table there, in place of those
    that an earlier run wrote for the same ``model_path`` and ``batch`` (by default the
    input path).
    """
    table = read_clean(spark, input_path, sep, infer_schema, schema, on_bad_cell, quarantine_path)
    model = load_model(model_path)
    forest = pipeline_forest(model)
    scored = score_batch(model, table)
    columns = forest.getLabelCol(), forest.getPredictionCol()
    if replicates:
        if not row_keys:
            raise ValueError("row_keys name the columns that replicates are drawn by")
        metrics = metric_intervals(bootstrap_confusion(scored, row_keys, *columns, replicates), level)
    else:
        metrics = metrics_table(scored, *columns)
    if metrics_path:
        paths = input_path if isinstance(input_path, str) else ",".join(input_path)
        write_metrics(metrics, metrics_path, model_path, batch or paths)
    return metrics
