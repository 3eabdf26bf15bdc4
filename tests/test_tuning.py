"""Trials scored in one scan, resumed runs, stratified folds and the bootstrap."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tabgrove.operators import trials
from tabgrove.operators.bootstrap import bootstrap_confusion, metric_intervals, poisson_limits
from tabgrove.operators.features import build_assembler
from tabgrove.operators.folds import FOLD_COL, assign_stratified_folds, training_rows, validation_rows
from tabgrove.operators.forest import build_forest, build_pipeline
from tabgrove.operators.labels import fit_label_index
from tabgrove.operators.number import number_rows
from tabgrove.operators.trials import point_counts, run_trials, table_fingerprint
from tabgrove.operators.tune import cross_validate, param_maps
from tabgrove.plans.jobs import train_classifier
from tabgrove.sources.shared import materialise, shared_folder

GRID = {"maxDepth": [1, 3], "impurity": ["entropy", "gini"]}


@pytest.fixture(scope="module")
def rows(spark):
    x, z = F.col("id") % 7, F.col("id") % 11
    df = spark.range(0, 330, 1, 3).select(
        x.cast("double").alias("x"),
        z.cast("double").alias("z"),
        F.when(x < 3, "low").when(z < 6, "mid").otherwise("high").alias("grade"),
        (F.col("id") % 3).cast("int").alias(FOLD_COL),
    )
    return materialise(df)


@pytest.fixture(scope="module")
def pipeline(rows):
    forest = build_forest(numTrees=3, maxDepth=3, seed=4)
    return build_pipeline(build_assembler(["x", "z"]), fit_label_index(rows, "grade"), forest)


def test_trials_equal_the_cross_validator(spark, rows, pipeline):
    ours, theirs = run_trials(rows, pipeline, GRID, 3, parallelism=2), cross_validate(rows, pipeline, GRID, 3)
    mine = {r["param_id"]: r for r in ours.trials.collect()}
    for row in theirs.trials.collect():
        own = mine[row["param_id"]]
        assert own["avg_accuracy"] == pytest.approx(row["avg_metric"], abs=1e-12)
        assert own["std_accuracy"] == pytest.approx(row["std_metric"], abs=1e-12)
        assert (own["maxDepth"], own["impurity"]) == (row["maxDepth"], row["impurity"])
    assert ours.best["param_id"] == theirs.best["param_id"]
    assert (ours.n_fitted, ours.n_reused) == (13, 0)
    assert [s.uid for s in ours.model.stages[:2]] == [s.uid for s in theirs.model.stages[:2]]


def test_every_metric_of_every_fold_equals_the_evaluator(rows, pipeline):
    found = {(r["param_id"], r["fold"]): r for r in run_trials(rows, pipeline, GRID, 3).folds.collect()}
    points = param_maps(pipeline.getStages()[-1], GRID)
    for fold in range(3):
        for i, point in enumerate(points):
            scored = pipeline.fit(training_rows(rows, fold), point).transform(validation_rows(rows, fold))
            for name, metric in (("accuracy", "accuracy"), ("weighted_f1", "f1")):
                expected = MulticlassClassificationEvaluator(metricName=metric).evaluate(scored)
                assert found[i, fold][name] == pytest.approx(expected, abs=1e-12)
    assert len(found) == 12


def test_all_models_of_a_fold_score_by_one_scan(rows, pipeline):
    points = param_maps(pipeline.getStages()[-1], GRID)
    models = [(i, pipeline.fit(training_rows(rows, 0), p)) for i, p in enumerate(points)]
    plan = point_counts(models, validation_rows(rows, 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_the_metric_decides(spark, rows, pipeline):
    by_f1 = run_trials(rows, pipeline, GRID, 3, metric="weighted_f1")
    best = max(by_f1.trials.collect(), key=lambda r: (r["avg_weighted_f1"], -r["param_id"]))
    assert by_f1.best["param_id"] == best["param_id"]
    with pytest.raises(ValueError, match="metric"):
        run_trials(rows, pipeline, GRID, 3, metric="hammingLoss")


@pytest.mark.parametrize("fold", ["CASE WHEN x = 0 THEN 9 ELSE 0 END", "CAST(NULL AS INT)", "0"])
def test_bad_folds_raise(rows, pipeline, fold):
    with pytest.raises(ValueError, match="fold"):
        run_trials(rows.withColumn(FOLD_COL, F.expr(fold)), pipeline, GRID, 3)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("k", [1, 5, 12])
def test_a_stopped_run_is_taken_up_without_fitting_again(spark, rows, pipeline, k, monkeypatch):
    log, fit, fits = shared_folder(spark), trials.fit_point, []

    def stopping(pipeline, df, point):
        if len(fits) == k:
            raise Stopped
        fits.append(1)
        return fit(pipeline, df, point)

    monkeypatch.setattr(trials, "fit_point", stopping)
    with pytest.raises(Stopped):
        run_trials(rows, pipeline, GRID, 3, log_path=log)
    monkeypatch.setattr(trials, "fit_point", fit)
    # The same rows in another layout are the same table.
    resumed = run_trials(rows.repartition(2), pipeline, GRID, 3, log_path=log)
    assert (resumed.n_fitted, resumed.n_reused) == (13 - k, k)
    whole = run_trials(rows, pipeline, GRID, 3, log_path=log)
    assert (whole.n_fitted, whole.n_reused) == (0, 13)
    assert whole.best == resumed.best and whole.trials.collect() == resumed.trials.collect()
    if k == 12:  # every trial came from one layout
        plain = run_trials(rows, pipeline, GRID, 3)
        assert plain.trials.collect() == whole.trials.collect()


def test_other_rows_folds_or_settings_are_other_trials(spark, rows, pipeline):
    log, grid = shared_folder(spark), {"maxDepth": [1]}
    run_trials(rows, pipeline, grid, 3, log_path=log)
    changed = rows.withColumn("x", F.when(F.col("x") == 6, 5.0).otherwise(F.col("x")))
    moved = rows.withColumn(FOLD_COL, ((F.col(FOLD_COL) + 1) % 3).cast("int"))
    for df in (changed, moved):
        assert run_trials(df, pipeline, grid, 3, log_path=log).n_reused == 0
    *before, _ = pipeline.getStages()
    other = build_pipeline(*before, build_forest(numTrees=4, maxDepth=3, seed=4))
    assert run_trials(rows, other, grid, 3, log_path=log).n_reused == 0
    assert run_trials(rows, pipeline, {"maxDepth": [2, 1]}, 3, log_path=log).n_reused >= 3


def test_fingerprints_know_rows_not_their_order(rows):
    mark = table_fingerprint(rows)
    assert mark == table_fingerprint(rows.orderBy(F.desc("z")).repartition(5))
    others = [rows.unionByName(rows), rows.where("x > 0"), rows.withColumnRenamed("x", "y"), rows.limit(0)]
    assert len({mark, *map(table_fingerprint, others)}) == 5


def test_training_takes_the_log_and_all_metrics(spark, rows):
    log = shared_folder(spark)
    args = {"forest": build_forest(numTrees=2, maxDepth=2), "grid": {"maxDepth": [1, 2]}, "fold_col": FOLD_COL, "num_folds": 3}
    first = train_classifier(rows, "grade", trial_log=log, **args)
    again = train_classifier(rows, "grade", trial_log=log, **args)
    assert (first.n_fitted, again.n_fitted) == (7, 0) and first.best == again.best


# --- folds ------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 3, 7])
def test_stratified_parts_are_at_most_one_apart(spark, k):
    labels = ["common"] * 500 + ["some"] * 23 + ["rare"] + [None] * 5 + ["pair"] * 2
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y string").repartition(4)
    out = assign_stratified_folds(df, "y", k, seed=1)
    assert out.columns == ["id", "y", FOLD_COL]
    found = [tuple(r) for r in out.collect()]
    assert sorted(r[0] for r in found) == list(range(len(labels)))
    for y in {*labels, "all"}:
        sizes = Counter(f for _, label, f in found if y in (label, "all"))
        parts = [sizes.get(f, 0) for f in range(k)]
        assert set(sizes) <= set(range(k)) and max(parts) - min(parts) <= 1, y


def test_stratified_folds_follow_the_seed_and_refuse_bad_arguments(spark):
    df = spark.range(200).withColumn("y", F.col("id") % 2)
    a, b, c = (
        {r["id"]: r[FOLD_COL] for r in assign_stratified_folds(df, "y", 2, seed).collect()} for seed in (1, 1, 2)
    )
    assert a == b and a != c
    with pytest.raises(ValueError, match="at least 2"):
        assign_stratified_folds(df, "y", 1)
    with pytest.raises(ValueError, match="exists"):
        assign_stratified_folds(df.withColumn(FOLD_COL, F.lit(1)), "y")
    assert assign_stratified_folds(df.limit(0), "y").count() == 0


def test_numbers_are_gapless_and_follow_the_order(spark):
    df = spark.createDataFrame([((i * 37) % 101, i) for i in range(400)], "a int, b int").repartition(6)
    rows = number_rows(df, [F.desc("a"), F.asc("b")], "n").collect()
    ordered = sorted(rows, key=lambda r: r["n"])
    assert [r["n"] for r in ordered] == list(range(400))
    assert [(-r["a"], r["b"]) for r in ordered] == sorted((-r["a"], r["b"]) for r in rows)


# --- bootstrap --------------------------------------------------------------------------


def pairs(n=120):
    return [(i, f"k{i % 50}", float(i % 3), float(i % 3 if i % 5 else 1)) for i in range(n)]


def weights(key, replicates, seed):
    """Poisson numbers by the hash's digits, by plain Python."""
    out = []
    for r in range(replicates):
        digest = hashlib.md5(f"{seed}:{r // 4}:{key}".encode()).hexdigest()
        u = int(digest[r % 4 * 8 : r % 4 * 8 + 8], 16)
        out.append(sum(u >= x for x in poisson_limits()))
    return out


def test_poisson_limits_are_the_distribution():
    k = np.arange(0, 8)
    chance = np.exp(-1) / np.array([float(np.prod(range(1, i + 1))) for i in k])
    assert np.diff([0, *poisson_limits()])[:8] / 2**32 == pytest.approx(chance, abs=1e-8)


def test_replicates_equal_brute_force_and_repeat(spark):
    df = spark.createDataFrame(pairs(), "id int, name string, label double, prediction double")
    found = bootstrap_confusion(df, ["id", "name"], replicates=10, seed=3)
    again = bootstrap_confusion(df.repartition(7), ["id", "name"], replicates=10, seed=3)
    expected = Counter()
    for i, name, label, prediction in pairs():
        for r, w in enumerate([1, *weights(f"{i}|{name}", 10, 3)]):
            expected[r, label, prediction] += w
    for out in (found, again):
        assert {tuple(x)[:3]: x["n"] for x in out.collect()} == {k: n for k, n in expected.items() if n}
    assert bootstrap_confusion(df, ["id", "name"], replicates=10, seed=4).collect() != found.collect()


def test_intervals_equal_brute_force(spark):
    df = spark.createDataFrame(pairs(), "id int, name string, label double, prediction double")
    rows = metric_intervals(bootstrap_confusion(df, ["id"], replicates=40, seed=1), level=0.8).collect()
    hits, total = defaultdict(int), defaultdict(int)
    for i, _, label, prediction in pairs():
        for r, w in enumerate([1, *weights(str(i), 40, 1)]):
            total[r] += w
            hits[r] += w * (label == prediction)
    drawn = [hits[r] / total[r] for r in range(1, 41)]
    row = next(r for r in rows if r["metric"] == "accuracy")
    assert row["value"] == pytest.approx(hits[0] / total[0]) and row["n_replicates"] == 40
    assert row["std"] == pytest.approx(np.std(drawn, ddof=1))
    assert (row["low"], row["high"]) == pytest.approx(tuple(np.quantile(drawn, [0.1, 0.9])))
    assert {r["metric"] for r in rows} == {"accuracy", "weighted_f1"}


def test_deviation_of_the_accuracy_is_that_of_a_share(spark):
    df = spark.range(4000).select("id", F.lit(1.0).alias("label"), (F.col("id") % 4 > 0).cast("double").alias("prediction"))
    row = metric_intervals(bootstrap_confusion(df, ["id"], replicates=100)).where("metric = 'accuracy'").collect()[0]
    assert row["std"] == pytest.approx((0.75 * 0.25 / 4000) ** 0.5, rel=0.3)
    assert row["low"] < row["value"] < row["high"]


def test_null_pairs_raise_and_null_keys_count(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (None, 1.0, 0.0)], "id int, label double, prediction double")
    assert bootstrap_confusion(df, ["id"], replicates=2).where("replicate = 0").count() == 2
    with pytest.raises(Exception, match="NULL"):
        bootstrap_confusion(df.withColumn("label", F.lit(None).cast("double")), ["id"]).collect()
