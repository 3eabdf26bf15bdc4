"""Whole jobs on small files, and a real forest on the labelled texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tabgrove.operators.features import build_assembler
from tabgrove.operators.folds import assign_folds
from tabgrove.operators.forest import build_forest, build_pipeline
from tabgrove.operators.labels import fit_label_index
from tabgrove.operators.score import score_batch
from tabgrove.operators.tune import DEFAULT_GRID, cross_validate
from tabgrove.plans.jobs import evaluate_job, profile_job, read_clean, score_job, train_classifier, train_job
from tabgrove.plans.queries import TEXT_FEATURES, damaged_csv, labelled_texts
from tabgrove.sources.shared import lay_out, materialise

SMALL_GRID = {"maxDepth": [1, 4], "impurity": ["entropy", "gini"]}


def measurements(spark, n=400):
    """Numeric columns with spaces in their names; ``grade`` follows from two of them."""
    acid, sugar = F.col("id") % 7, F.col("id") % 11
    return spark.range(0, n, 1, 4).select(
        (acid / 2).alias("fixed part"),
        sugar.cast("int").alias("rest sugar"),
        (F.col("id") % 5).cast("int").alias("noise"),
        F.when(acid < 3, 5).when(sugar < 6, 6).otherwise(7).cast("int").alias("grade"),
    )


@pytest.fixture(scope="module")
def text_path(spark):
    return damaged_csv(measurements(spark))


def forest(**params):
    return build_forest(numTrees=5, maxDepth=4, **params)


@pytest.fixture(scope="module")
def trained(spark, text_path, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "m")
    run = train_job(
        spark, text_path, path, "grade", forest=forest(), grid=SMALL_GRID, num_folds=3, parallelism=4
    )
    return run, path


def test_train_job(spark, trained):
    run, path = trained
    trials = run.trials.orderBy("param_id").collect()
    assert run.trials.columns == ["param_id", "maxDepth", "impurity", "avg_metric", "std_metric"]
    assert [(t.maxDepth, t.impurity) for t in trials] == [
        (1, "entropy"), (1, "gini"), (4, "entropy"), (4, "gini"),
    ]
    top = max(t.avg_metric for t in trials)
    assert run.best == next(t for t in trials if t.avg_metric == top).asDict()
    assert run.best["maxDepth"] == 4 and top > 0.8
    assert [type(s).__name__ for s in PipelineModel.load(path).stages] == [
        "VectorAssembler", "StringIndexerModel", "RandomForestClassificationModel",
    ]
    assert run.model.stages[-1].getMaxDepth() == 4
    assert run.model.stages[0].getInputCols() == ["fixed part", "rest sugar", "noise"]


def test_score_and_evaluate_jobs(spark, trained, text_path):
    run, path = trained
    scored = score_job(spark, text_path, path)
    assert scored.count() == 400
    metrics = {r.metric: r.value for r in evaluate_job(spark, text_path, path).collect()}
    hits = scored.filter(F.col("predicted") == F.col("grade").cast("string")).count()
    assert metrics["accuracy"] == pytest.approx(hits / 400) and metrics["accuracy"] > 0.8
    for name, metric in (("accuracy", "accuracy"), ("f1", "weighted_f1")):
        theirs = MulticlassClassificationEvaluator(metricName=name).evaluate(scored)
        assert metrics[metric] == pytest.approx(theirs, abs=1e-12)


def test_same_table_and_seed_same_result(spark):
    """Forests depend on how rows are partitioned; over one table a run can be repeated."""
    table = materialise(assign_folds(measurements(spark), 2, seed=5))
    pipeline = build_pipeline(
        build_assembler(["noise", "rest sugar"]), fit_label_index(table, "grade"), forest(seed=3)
    )
    runs = [cross_validate(table, pipeline, SMALL_GRID, parallelism=p) for p in (1, 3)]
    assert runs[0].best == runs[1].best
    assert runs[0].trials.exceptAll(runs[1].trials).isEmpty()
    trees = [run.model.stages[-1].toDebugString.split("\n")[1:] for run in runs]
    assert trees[0] == trees[1] and len(trees[0]) > 5


def test_laid_out_rows_come_in_the_same_order_every_time(spark):
    scan = materialise(measurements(spark)).coalesce(2)

    def rows():
        placed = lay_out(scan, 8).select("*", F.monotonically_increasing_id().alias("place"))
        return sorted(map(tuple, placed.collect()))

    assert rows() == rows()


@pytest.mark.parametrize("naming", [{"fold_keys": ["key"]}, {"fold_col": "key"}])
def test_columns_that_name_folds_are_no_features(spark, naming):
    row = F.monotonically_increasing_id()
    table = measurements(spark).withColumn("key", row % 2 if "fold_col" in naming else row)
    run = train_classifier(
        table, "grade", forest=forest(), grid={"impurity": ["gini"]}, metric="f1", **naming
    )
    assert run.model.stages[0].getInputCols() == ["fixed part", "rest sugar", "noise"]
    assert run.best["avg_metric"] > 0.8


def test_awkward_names_from_end_to_end(spark):
    table = measurements(spark).toDF("fixed.part", "rest `sugar`", "no ise", "gr.ade")
    run = train_classifier(table, "gr.ade", forest=forest(), grid={"impurity": ["gini"]})
    scored = score_batch(run.model, table)
    assert scored.filter(F.col("predicted") == F.col("`gr.ade`").cast("string")).count() > 320


def test_a_label_column_called_label(spark, tmp_path):
    table = measurements(spark).withColumnRenamed("grade", "label")
    grid = {"subsamplingRate": np.linspace(0.5, 1.0, 2)}
    with pytest.raises(ValueError, match="named like output columns"):
        train_classifier(table, "label", forest=forest(), grid=grid)
    path = str(tmp_path / "m")
    run = train_job(
        spark, damaged_csv(table), path, "label", forest=forest(labelCol="label_index"), grid=grid
    )
    assert [t.subsamplingRate for t in run.trials.orderBy("param_id").collect()] == [0.5, 1.0]
    metrics = evaluate_job(spark, damaged_csv(table), path).collect()
    assert {m.metric: m.value for m in metrics}["accuracy"] > 0.8


def test_label_living_in_one_fold_only(spark):
    """The dictionary is fitted before the folds, so its validation rows can be indexed."""
    table = measurements(spark).withColumn("fold", F.monotonically_increasing_id() % 2)
    rare = table.limit(1).withColumns({"grade": F.lit(3), "fold": F.lit(0).cast("long")})
    run = train_classifier(
        table.unionByName(rare),
        "grade",
        features=["fixed part", "rest sugar"],
        forest=forest(),
        grid={"impurity": ["gini"]},
        fold_col="fold",
    )
    assert run.model.stages[1].labels[-1] == "3"


@pytest.mark.parametrize("fold", [2, -1])
def test_fold_out_of_range(spark, fold):
    table = measurements(spark, 40).withColumn("fold", F.lit(fold))
    with pytest.raises(Exception, match="(?i)fold"):
        train_classifier(
            table, "grade", ["noise"], forest=forest(), grid={"impurity": ["gini"]}, fold_col="fold"
        )


def test_label_leak_is_refused_and_can_be_forced(spark):
    table = measurements(spark)
    with pytest.raises(ValueError, match="among the features"):
        train_classifier(table, "grade", features=table.columns)
    run = train_classifier(
        table,
        "grade",
        features=["noise", "grade"],
        allow_label_feature=True,
        forest=build_forest(numTrees=20, maxDepth=3, featureSubsetStrategy="all"),
        grid={"impurity": ["gini"]},
    )
    assert run.best["avg_metric"] == 1.0


def test_default_grid_runs_in_full(spark):
    """16 points, two folds, one refit: the default tuning run, on few rows."""
    run = train_classifier(measurements(spark, 120), "grade", parallelism=8)
    assert run.trials.count() == 16
    assert set(run.trials.columns) == {"param_id", "avg_metric", "std_metric", *DEFAULT_GRID}
    assert run.model.stages[-1].getNumTrees in (50, 150)


def test_forest_beats_the_majority_on_held_out_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    (row,) = contract.queries()["quality_metrics"](spark, sf_dir).collect()
    held_out = labelled_texts(spark, sf_dir).where("doc_id % 4 = 0")
    assert row.n_held_out == held_out.count() and row.n_good == held_out.where("quality = 1").count()
    assert row.beats_majority
    assert set(TEXT_FEATURES) < set(held_out.columns)


def test_entry(spark):
    (row,) = contract.entry(spark).collect()
    assert row.n_held_out > row.n_good > 0


def test_profile_gives_the_schema_of_the_other_jobs(spark, text_path):
    profile, schema = profile_job(spark, text_path)
    rows = {r["name"]: r for r in profile.collect()}
    assert {n: r["type"] for n, r in rows.items()} == {
        "fixed part": "double", "rest sugar": "int", "noise": "int", "grade": "int",
    }
    assert rows["grade"]["n_rows"] == 400 and (rows["grade"]["least"], rows["grade"]["greatest"]) == (5.0, 7.0)
    typed = read_clean(spark, text_path, schema=schema)
    assert typed.exceptAll(read_clean(spark, text_path)).count() == 0 and typed.count() == 400


def test_training_refuses_leaks_on_request(spark):
    rows = measurements(spark).withColumn("copy", F.col("grade") * 2.0)
    with pytest.raises(ValueError, match=r"\['copy'\]"):
        train_classifier(rows, "grade", forest=forest(), grid={"maxDepth": [2]}, leak_threshold=0.99)
    trained = train_classifier(rows.drop("copy"), "grade", forest=forest(), grid={"maxDepth": [2]}, leak_threshold=0.99)
    assert trained.trials.count() == 1
    # A label among its features is insisted on, so it is not what is refused.
    args = {"features": ["grade", "noise"], "allow_label_feature": True, "forest": forest(), "grid": {"maxDepth": [2]}}
    assert train_classifier(rows, "grade", leak_threshold=0.99, **args).best["avg_metric"] == 1.0


def test_training_over_stratified_folds(spark):
    rows = measurements(spark).withColumn("grade", F.when(F.col("noise") > 9, 5).otherwise(F.col("grade")))
    rare = rows.limit(2).withColumn("grade", F.lit(9).cast("int")).withColumn("noise", F.lit(77).cast("int"))
    both = rows.unionByName(rare)
    args = {"forest": forest(), "grid": {"maxDepth": [1, 4]}, "one_scan": True}
    tuned = train_classifier(both, "grade", stratified=True, seed=2, **args)
    # Both folds hold one row of the rare label, so both train on one.
    counts = tuned.folds.select("fold").distinct().count()
    assert counts == 2 and tuned.best["maxDepth"] == 4
    with pytest.raises(ValueError, match="stratified"):
        train_classifier(both, "grade", stratified=True, fold_keys=["noise"], **args)


def test_evaluation_with_error_bars(spark, trained, text_path):
    _, path = trained
    plain = {r["metric"]: r["value"] for r in evaluate_job(spark, text_path, path).collect()}
    keys = ["fixed part", "rest sugar", "noise"]
    rows = evaluate_job(spark, text_path, path, replicates=20, row_keys=keys).collect()
    assert {r["metric"]: r["value"] for r in rows} == pytest.approx(plain)
    assert all(r["low"] <= r["value"] <= r["high"] and r["n_replicates"] == 20 for r in rows)
    with pytest.raises(ValueError, match="row_keys"):
        evaluate_job(spark, text_path, path, replicates=20)
