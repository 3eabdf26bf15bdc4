"""Edge rows, failures and parity with Spark's own estimators and evaluators."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.mllib.evaluation import MulticlassMetrics
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgrove.functions.names import check_distinct, ml_name, quoted, strip_quotes
from tabgrove.operators.clean import clean_columns
from tabgrove.operators.evaluate import (
    accuracy,
    confusion_matrix,
    metrics_table,
    per_label,
    weighted_f1,
)
from tabgrove.operators.features import assemble, assemble_long, select_features
from tabgrove.operators.folds import assign_folds, training_rows, validation_rows
from tabgrove.operators.forest import DEFAULT_FOREST, build_forest, fit_pipeline
from tabgrove.operators.labels import apply_label_index, fit_label_index, label_table
from tabgrove.operators.score import score_batch
from tabgrove.operators.tune import best_trial, grid_points, param_maps
from tabgrove.plans.jobs import train_classifier
from tabgrove.sources.models import load_model, save_model, tree_nodes
from tabgrove.sources.shared import lay_out, materialise, materialised, shared_folder

NAN = float("nan")


# --- names and cleaning -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "clean"),
    [('"""a""""', "a"), ('""""b""""', "b"), ("a.b", "a.b"), ('in"ner', 'in"ner'), ('""', "")],
)
def test_strip_quotes(raw, clean):
    assert strip_quotes(raw) == clean


@settings(max_examples=25, deadline=None)
@given(name=st.text(st.characters(codec="ascii", categories=("L", "N", "P", "Zs")), min_size=1))
def test_any_name_survives_quoting(spark, name):
    df = spark.range(1).toDF(name)
    assert df.select(F.col(quoted(name))).columns == [name]


def test_ml_name_quotes_only_what_would_be_parsed():
    assert ml_name("fixed acidity") == "fixed acidity"
    assert ml_name("a.b") == "`a.b`"


def test_clean_names_and_types(spark):
    raw = spark.createDataFrame(
        [(1, 2.5, "3", True)], T.StructType.fromDDL("a int, b double, c string, d boolean")
    ).toDF('"""a""""', '""""b""""', "c.d", '"e f"')
    clean = clean_columns(raw)
    assert clean.columns == ["a", "b", "c.d", "e f"]
    assert {t for _, t in clean.dtypes} == {"double"}
    assert [tuple(r) for r in clean.collect()] == [(1.0, 2.5, 3.0, 1.0)]


def test_clean_bad_cells_become_null(spark):
    raw = spark.createDataFrame([("1.5",), ("abc",), ("",), (None,)], "x string")
    assert [r.x for r in clean_columns(raw).collect()] == [1.5, None, None, None]


@pytest.mark.parametrize("cell", ["abc", ""])
def test_clean_bad_cells_can_fail(spark, cell):
    raw = spark.createDataFrame([("1.5",), (cell,)], "x string")
    with pytest.raises(Exception, match="not a number in column x"):
        clean_columns(raw, on_bad_cell="fail").collect()


def test_clean_fail_keeps_null_and_numbers(spark):
    raw = spark.createDataFrame([("1.5",), (None,), ("NaN",)], "x string")
    values = [r.x for r in clean_columns(raw, on_bad_cell="fail").collect()]
    assert values[:2] == [1.5, None] and values[2] != values[2]


def test_clean_dates_are_not_numbers(spark):
    raw = spark.sql("SELECT date'2020-01-01' AS d, timestamp'1970-01-02 00:00:00' AS t")
    assert [tuple(r) for r in clean_columns(raw).collect()] == [(None, 86400.0)]
    with pytest.raises(Exception, match="not a number in column d"):
        clean_columns(raw, on_bad_cell="fail").collect()


@pytest.mark.parametrize("names", [('"a"', "a"), ('"a"', "A")])
def test_clean_collision(spark, names):
    raw = spark.createDataFrame([(1, 2)], "x int, y int").toDF(*names)
    with pytest.raises(ValueError, match="collide"):
        clean_columns(raw)


def test_collision_follows_case_sensitivity(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        check_distinct(spark, ["a", "A"])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_clean_unknown_mode(spark):
    with pytest.raises(ValueError, match="on_bad_cell"):
        clean_columns(spark.range(1), on_bad_cell="drop")


def test_clean_is_one_projection(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_retailprice")
    plan = clean_columns(part.toDF('"p_size"', '"p_retailprice"')).select("p_size")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Project") == 1
    assert "ReadSchema: struct<p_size:int>" in text


# --- features ---------------------------------------------------------------------------


def test_select_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, y double")
    assert select_features(df, "y") == ["a", "b"]
    assert select_features(df, "y", ["b"]) == ["b"]
    assert select_features(df, "y", ["a", "y"], allow_label_feature=True) == ["a", "y"]
    with pytest.raises(ValueError, match="among the features"):
        select_features(df, "y", ["a", "y"])
    with pytest.raises(ValueError, match="no such columns"):
        select_features(df, "y", ["a", "z"])
    with pytest.raises(ValueError, match="no feature columns"):
        select_features(df.select("y"), "y")


@pytest.mark.parametrize("bad", [None, NAN])
def test_missing_feature(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "a double")
    with pytest.raises(Exception, match="(?i)null|nan"):
        assemble(df, ["a"]).select("features").collect()
    assert assemble(df, ["a"], handle_invalid="skip").count() == 1
    assert assemble(df, ["a"], handle_invalid="keep").count() == 2


def test_assemble_awkward_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7)], "x double, y double, k int").toDF("a.b", "c d", "k")
    rows = assemble_long(df, ["k"], ["c d", "a.b"]).orderBy("pos").collect()
    assert [(r.k, r.pos, r.value) for r in rows] == [(7, 0, 2.0), (7, 1, 1.0)]


# --- labels -----------------------------------------------------------------------------


def labels(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"y {kind}")


def test_label_ranking(spark):
    df = labels(spark, [1.0, 2.0, 2.0, 10.0, None])
    assert fit_label_index(df, "y").labels == ["2.0", "1.0", "10.0"]


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        ([1.0, 2.0, 2.0, 10.0, None, NAN, 0.0, -0.0], "double"),
        ([5, 5, 3, 40, 40, 7, None], "int"),
        (["b", "a", "a ", "", None, "b", "ä", "Z"], "string"),
    ],
)
def test_label_index_equals_string_indexer(spark, values, kind):
    df = labels(spark, values, kind)
    theirs = StringIndexer(inputCol="y", outputCol="label").fit(df)
    ours = fit_label_index(df, "y")
    assert ours.labels == list(theirs.labels)
    present = df.na.drop()
    assert apply_label_index(present, ours).collect() == theirs.transform(present).collect()


@pytest.mark.parametrize("bad", [7.0, None, NAN])
def test_unknown_label_raises(spark, bad):
    model = fit_label_index(labels(spark, [1.0, 2.0]), "y")
    with pytest.raises(Exception):
        apply_label_index(labels(spark, [bad]), model).select("label").collect()


def test_unknown_label_can_be_skipped_or_kept(spark):
    df = labels(spark, [1.0, 7.0, None])
    for mode, kept in (("skip", [0.0]), ("keep", [0.0, 1.0, 1.0])):
        model = fit_label_index(labels(spark, [1.0]), "y", handle_invalid=mode)
        assert [r.label for r in apply_label_index(df, model).collect()] == kept


def test_no_labels(spark):
    with pytest.raises(ValueError, match="no labels"):
        fit_label_index(labels(spark, [None, NAN]), "y")


def test_every_label_is_there_whatever_is_read(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("y"))
    labels = label_table(df, "y")
    assert labels.count() == 20_000
    assert labels.select("label", "n").agg(F.sum("n")).collect()[0][0] == 60_000
    assert sorted(row.idx for row in labels.select("idx").collect()) == list(range(20_000))
    with pytest.raises(ValueError, match="more than 5 labels"):
        fit_label_index(df, "y", max_labels=5)


def test_training_on_too_many_labels_raises(spark):
    forest = build_forest(numTrees=1)
    with pytest.raises(Exception, match="more than 1 labels"):
        fit_pipeline(tiny(spark), "quality", forest, max_labels=1)
    with pytest.raises(Exception, match="more than 1 labels"):
        train_classifier(tiny(spark), "quality", forest=forest, max_labels=1)


def test_one_label_holding_most_rows(spark):
    df = spark.range(0, 100_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("y")
    )
    rows = label_table(df, "y").orderBy("idx").collect()
    assert rows[0].label == "hot" and sum(r.n for r in rows) == 100_000


# --- folds ------------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [None, ["id"]])
@pytest.mark.parametrize("k", [2, 5])
def test_folds_partition_the_rows(spark, keys, k):
    df = materialise(assign_folds(spark.range(5000), k, seed=11, keys=keys))
    parts = [validation_rows(df, f).count() for f in range(k)]
    assert sum(parts) == 5000
    assert all(abs(n - 5000 / k) < 400 for n in parts)
    for f in range(k):
        assert training_rows(df, f).count() == 5000 - parts[f]


def test_key_folds_ignore_partitioning(spark):
    df = spark.range(1000)
    one = assign_folds(df.repartition(1), 3, keys=["id"])
    many = assign_folds(df.repartition(7), 3, keys=["id"])
    assert one.exceptAll(many).isEmpty()
    assert not one.exceptAll(assign_folds(df, 3, seed=1, keys=["id"])).isEmpty()


def test_fold_arguments(spark):
    with pytest.raises(ValueError, match="at least 2"):
        assign_folds(spark.range(1), 1)
    with pytest.raises(ValueError, match="exists already"):
        assign_folds(spark.range(1), 2, fold_col="ID")


# --- evaluation -------------------------------------------------------------------------


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "label double, prediction double")


def brute_metrics(rows):
    total = len(rows)
    f1 = 0.0
    for label in {a for a, _ in rows}:
        true = sum(a == label for a, _ in rows)
        predicted = sum(b == label for _, b in rows)
        hits = sum(a == b == label for a, b in rows)
        f1 += true / total * (2 * hits / (true + predicted) if hits else 0.0)
    return sum(a == b for a, b in rows) / total, f1


@settings(max_examples=15, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), min_size=1, max_size=40))
def test_metrics_equal_brute_force_and_evaluator(spark, rows):
    df = pairs(spark, rows)
    ours = {r.metric: r.value for r in metrics_table(df).collect()}
    acc, f1 = brute_metrics(rows)
    assert ours["accuracy"] == pytest.approx(acc, abs=1e-12)
    assert ours["weighted_f1"] == pytest.approx(f1, abs=1e-12)
    for name, metric in (("accuracy", "accuracy"), ("f1", "weighted_f1")):
        theirs = MulticlassClassificationEvaluator(metricName=name).evaluate(df)
        assert ours[metric] == pytest.approx(theirs, abs=1e-12)


def test_weighted_f1_equals_the_rdd_metrics(spark):
    df = pairs(spark, [(0, 0), (0, 3), (0, 1), (1, 1), (1, 0), (2, 1), (2, 1), (4, 4)])
    theirs = MulticlassMetrics(df.select("prediction", "label").rdd.map(tuple))
    assert weighted_f1(df).first().weighted_f1 == pytest.approx(theirs.weightedFMeasure(), abs=1e-12)
    assert accuracy(df).first().accuracy == pytest.approx(theirs.accuracy, abs=1e-12)


def test_labels_never_predicted_and_predictions_never_labelled(spark):
    df = pairs(spark, [(0, 0), (0, 3), (1, 0), (2, 1)])
    rows = {r.label: r for r in per_label(confusion_matrix(df)).collect()}
    assert set(rows) == {0.0, 1.0, 2.0}
    assert rows[2.0].f1 == rows[2.0].precision == rows[2.0].recall == 0.0
    assert (rows[0.0].n_true, rows[0.0].n_predicted, rows[0.0].n_hit) == (2, 2, 1)


@pytest.mark.parametrize("row", [(None, 1.0), (1.0, None)])
def test_null_pairs_raise(spark, row):
    df = spark.createDataFrame([row], "label double, prediction double")
    for metric in (confusion_matrix, weighted_f1, metrics_table):
        with pytest.raises(Exception, match="NULL in column"):
            metric(df).collect()


def test_metrics_of_no_rows(spark):
    df = spark.createDataFrame([], "label double, prediction double")
    assert {r.value for r in metrics_table(df).collect()} == {None}


def test_metrics_scan_the_input_once(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_tax").alias("label"), F.col("l_discount").alias("prediction"), "l_quantity"
    )
    plan = metrics_table(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in plan


# --- forest, grid, models ---------------------------------------------------------------


def tiny(spark, label_kind="double"):
    """Two features, of which the first decides the label."""
    return spark.range(0, 200, 1, 4).select(
        (F.col("id") % 10).cast("double").alias("a.x"),
        (F.col("id") % 3).cast("double").alias("b y"),
        F.when(F.col("id") % 10 < 5, 3).otherwise(8).cast(label_kind).alias("quality"),
    )


def test_build_forest_defaults(spark):
    forest = build_forest()
    assert {name: forest.getOrDefault(name) for name in DEFAULT_FOREST} == {
        "numTrees": 150,
        "maxDepth": 15,
        "seed": 150,
        "impurity": "gini",
    }
    assert build_forest(numTrees=3).getNumTrees() == 3


def test_default_grid(spark):
    points = grid_points(build_forest())
    assert len(points) == 16
    assert [p["param_id"] for p in points] == list(range(16))
    assert points[0] == {
        "param_id": 0,
        "maxDepth": 5,
        "numTrees": 50,
        "minInstancesPerNode": 5,
        "seed": 100,
        "impurity": "entropy",
    }
    assert points[1]["impurity"] == "gini" and points[2]["seed"] == 200
    assert len(param_maps(build_forest())) == 16


def test_best_trial_prefers_the_first_of_equals(spark):
    trials = spark.createDataFrame(
        [(0, 0.5), (2, 0.7), (1, 0.7)], "param_id long, avg_metric double"
    )
    assert best_trial(trials).first().param_id == 1
    assert best_trial(trials, larger_is_better=False).first().param_id == 0


def test_fit_save_load_score(spark, tmp_path):
    rows = tiny(spark)
    forest = build_forest(numTrees=5, maxDepth=3, seed=1)
    model = fit_pipeline(rows, "quality", forest)
    path = f"file://{tmp_path}/model"
    save_model(model, path)
    with pytest.raises(Exception, match="already exists"):
        save_model(model, path, overwrite=False)
    save_model(model, path)

    expected = score_batch(model, rows)
    reloaded = score_batch(load_model(path), rows)
    assert reloaded.columns == expected.columns
    assert dict(reloaded.dtypes)["probability"] == "array<double>"
    assert reloaded.exceptAll(expected).isEmpty() and expected.exceptAll(reloaded).isEmpty()
    assert reloaded.filter(F.col("predicted") != F.col("quality").cast("string")).isEmpty()


@pytest.mark.parametrize("cache", [True, False])
def test_fit_leaves_nothing_cached(spark, cache):
    rows = tiny(spark).withColumn("unused", F.lit("text"))
    features = ["a.x", "b y"]
    model = fit_pipeline(rows, "quality", build_forest(numTrees=1), features, cache=cache)
    assert model.stages[-1].numFeatures == 2
    assert not rows.select("`a.x`", "`b y`", "quality").is_cached
    plan = rows.select("`a.x`", "`b y`", "quality")._jdf.queryExecution().executedPlan().toString()
    assert "InMemory" not in plan


def test_score_without_label(spark):
    rows = tiny(spark)
    model = fit_pipeline(rows, "quality", build_forest(numTrees=2, maxDepth=2))
    scored = score_batch(model, rows.drop("quality"))
    assert "label" not in scored.columns
    assert scored.filter("predicted IN ('3.0', '8.0')").count() == 200
    for name in ("Prediction", "PREDICTED", "features"):
        with pytest.raises(ValueError, match="collide"):
            score_batch(model, rows.withColumn(name, F.lit("kept")))
    with pytest.raises(ValueError, match="collide"):
        score_batch(model, rows.withColumn("predicted", F.lit(1)))


def test_scored_columns_are_pruned(spark):
    rows = tiny(spark)
    model = fit_pipeline(rows, "quality", build_forest(numTrees=2, maxDepth=2))
    metrics = confusion_matrix(score_batch(model, rows))
    plan = metrics._jdf.queryExecution().optimizedPlan().toString()
    assert "probability" not in plan and "predicted" not in plan


def test_label_as_feature_needs_the_flag(spark):
    rows, forest = tiny(spark), build_forest(numTrees=2, maxDepth=2)
    names = ["a.x", "quality"]
    with pytest.raises(ValueError, match="among the features"):
        fit_pipeline(rows, "quality", forest, names)
    model = fit_pipeline(rows, "quality", forest, names, allow_label_feature=True)
    assert model.stages[-1].numFeatures == 2
    with pytest.raises(Exception, match="quality"):
        score_batch(model, rows.drop("quality")).collect()


def test_tree_nodes(spark, tmp_path):
    model = fit_pipeline(
        tiny(spark), "quality", build_forest(numTrees=1, maxDepth=1, bootstrap=False,
                                             featureSubsetStrategy="all")
    )
    save_model(model, str(tmp_path / "m"))
    nodes = {n.node_id: n for n in tree_nodes(spark, str(tmp_path / "m")).collect()}
    assert (nodes[0].feature, nodes[0].threshold, nodes[0].gain) == (0, 4.5, 0.5)
    assert nodes[0].n_rows == 200
    leaves = [nodes[nodes[0].left_child], nodes[nodes[0].right_child]]
    assert [(n.left_child, n.threshold, n.gain, n.n_rows) for n in leaves] == [(-1, None, None, 100)] * 2


def test_pruned_root_is_a_leaf(spark, tmp_path):
    rows = tiny(spark).withColumn("quality", F.lit(1.0))
    model = fit_pipeline(rows, "quality", build_forest(numTrees=1, maxDepth=1))
    save_model(model, str(tmp_path / "m"))
    root = tree_nodes(spark, str(tmp_path / "m")).first()
    assert (root.left_child, root.threshold, root.feature) == (-1, None, None)


# --- working tables ---------------------------------------------------------------------


def test_materialise_pins_random_columns_and_keeps_metadata(spark):
    df = apply_label_index(tiny(spark), fit_label_index(tiny(spark), "quality"))
    table = materialise(df.withColumn("r", F.rand()))
    assert table.exceptAll(table).isEmpty()
    assert table.schema["label"].metadata == df.schema["label"].metadata != {}
    assert table.count() == 200


def test_materialised_table_is_emptied(spark):
    with materialised(spark.range(100)) as table:
        files = table.inputFiles()
        assert table.count() == 100
    folder = files[0].rsplit("/", 1)[0]
    assert spark.read.schema("id long").parquet(folder).isEmpty()


def test_layout_is_what_was_asked_for(spark):
    wide = spark.range(0, 100, 1, 3)
    assert lay_out(wide) is wide
    assert lay_out(spark.range(0, 100, 1, 1), 5).rdd.getNumPartitions() == 5
    assert materialise(wide, 7).count() == 100


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder != shared_folder(spark)
    if base:
        assert folder.startswith(base)


def test_unset_setting_reads_as_none(spark):
    assert spark.conf.get("spark.no.such.setting", None) is None


class ClusterSession:
    """Just the settings of a session on a cluster."""

    class conf:
        settings: dict[str, str] = {}

        @classmethod
        def get(cls, name, default=None):
            return cls.settings.get(name, default)

    class sparkContext:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None


def test_shared_folder_is_never_local_on_a_cluster(monkeypatch):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(ClusterSession)
    monkeypatch.setitem(ClusterSession.conf.settings, "spark.checkpoint.dir", "hdfs:///work/")
    assert shared_folder(ClusterSession).startswith("hdfs:///work/tabgrove-")


def test_shared_folder_of_a_local_session_without_the_setting(monkeypatch):
    monkeypatch.setattr(ClusterSession.sparkContext, "master", "local[2]")
    first, second = shared_folder(ClusterSession), shared_folder(ClusterSession)
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
