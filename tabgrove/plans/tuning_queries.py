"""Queries over tuning and what it leaves: trials, logs, folds, error bars, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabgrove.operators.bootstrap import bootstrap_confusion, metric_intervals, poisson_limits
from tabgrove.operators.folds import FOLD_COL, assign_stratified_folds, fold_counts
from tabgrove.operators.forest import fit_pipeline
from tabgrove.plans.jobs import train_classifier
from tabgrove.plans.oracles import _F1, SIGNAL, _stump, _tuned_stump
from tabgrove.plans.queries import Query, labelled_items, laid_out, stump, table
from tabgrove.sources.models import load_model, model_versions, prune_models, publish_model, tree_nodes
from tabgrove.sources.shared import materialise, shared_folder


def tuned_in_one_scan(rows, impurities, **options):
    """As ``queries.tuned_stump``, each fold's models scored together."""
    return train_classifier(
        rows.withColumn("fold", F.col("l_orderkey") % 2),
        "kind",
        features=["l_discount"],
        forest=stump(),
        grid={"impurity": impurities},
        fold_col="fold",
        parallelism=2,
        one_scan=True,
        **options,
    )


def cv_all_metrics(spark, sf_dir):
    """Accuracy and weighted F1 of every point and fold, from one scan for each fold."""
    tuned = tuned_in_one_scan(labelled_items(spark, sf_dir), ["entropy", "gini"])
    return tuned.folds.select(
        "param_id",
        "fold",
        F.round("accuracy", 9).alias("accuracy"),
        F.round("weighted_f1", 9).alias("weighted_f1"),
        (F.col("param_id") == tuned.best["param_id"]).alias("is_best"),
    )


def cv_resumed(spark, sf_dir):
    """A run that knows the first point only, then one of both points with its log: the
    first point's models are not fitted again."""
    rows, log = labelled_items(spark, sf_dir), shared_folder(spark)
    tuned_in_one_scan(rows, ["entropy"], trial_log=log)
    tuned = tuned_in_one_scan(rows, ["entropy", "gini"], trial_log=log)
    return tuned.trials.select(
        "param_id",
        "impurity",
        *(F.round(f"{kind}_accuracy", 9).alias(f"{kind}_accuracy") for kind in ("avg", "std")),
        F.lit(tuned.n_fitted).cast("long").alias("n_fitted"),
        F.lit(tuned.n_reused).cast("long").alias("n_reused"),
    )


def model_publishing(spark, sf_dir):
    """Two models published at one path: the splits of the current and the earlier one,
    and how many are left when all but the current are removed."""
    rows, path = laid_out(labelled_items(spark, sf_dir).select("l_discount", "kind")), shared_folder(spark)
    for impurity in ("gini", "entropy"):
        publish_model(fit_pipeline(rows, "kind", stump(impurity=impurity), ["l_discount"]), path)
    current, earlier = model_versions(spark, path)
    nodes = tree_nodes(spark, path).withColumn("version", F.lit("current"))
    nodes = nodes.unionByName(
        tree_nodes(spark, f"{path}/versions/{earlier}").withColumn("version", F.lit("earlier"))
    )
    roots = materialise(nodes.where("node_id = 0"))
    prune_models(spark, path, keep=1)
    same = load_model(path).uid == load_model(path, current).uid
    return roots.select(
        "version",
        F.round("threshold", 9).alias("threshold"),
        F.lit(len(model_versions(spark, path))).cast("long").alias("n_left"),
        F.lit(same).alias("is_current"),
    )


STRATIFIED = 4


def kfold_stratified(spark, sf_dir):
    """Least and greatest part of each label over four folds, for common labels, one that
    occurs once, and all rows together."""
    rare = F.when(F.col("l_orderkey") * 10 + F.col("l_linenumber") == F.lit(11), "once")
    label = F.coalesce(rare, F.col("l_quantity").cast("int").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("kind"))
    folded = assign_stratified_folds(rows, "kind", STRATIFIED, seed=3)
    parts = materialise(fold_counts(folded, "kind", FOLD_COL))
    whole = parts.groupBy("fold").agg(F.lit("all").alias("label"), F.sum("n").alias("n"))
    sizes = parts.unionByName(whole).groupBy("label").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_folds"),
        F.max("n").alias("most"),
        F.min("n").alias("least_held"),
    )
    return sizes


REPLICATES = 20


def resampled(spark, sf_dir):
    """The rule's pairs with twenty replicates, drawn by the line items' key."""
    rows = ruled_with_key(spark, sf_dir)
    return bootstrap_confusion(rows, ["l_orderkey", "l_linenumber"], replicates=REPLICATES, seed=9)


def ruled_with_key(spark, sf_dir):
    flag = F.col("l_returnflag")
    label = F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2)
    rule = F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_tax") > 0.07, 3).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", label.cast("double").alias("label"), rule.cast("double").alias("prediction")
    )


def bootstrap_counts(spark, sf_dir):
    return resampled(spark, sf_dir)


def bootstrap_intervals(spark, sf_dir):
    intervals = metric_intervals(resampled(spark, sf_dir), level=0.9)
    rounded = {name: F.round(name, 9) for name in ("value", "std", "low", "high")}
    return intervals.withColumns(rounded)


_RULED_WITH_KEY = (
    "SELECT l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS key, "
    "CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END::DOUBLE AS label, "
    "CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_tax > 0.07 THEN 3 ELSE 1 END::DOUBLE AS prediction FROM lineitem"
)
_WEIGHT = " + ".join(f"(u >= {limit})::BIGINT" for limit in poisson_limits())
_RESAMPLED = f"""k AS ({_RULED_WITH_KEY}),
u AS (
  SELECT label, prediction, r + 1 AS replicate,
    ('0x' || substr(md5('9:' || (r // 4)::VARCHAR || ':' || key), (r % 4 * 8 + 1)::INT, 8))::BIGINT AS u
  FROM k, range({REPLICATES}) t(r)),
counts AS (
  SELECT replicate, label, prediction, sum({_WEIGHT})::BIGINT AS n FROM u GROUP BY ALL HAVING sum({_WEIGHT}) > 0
  UNION ALL SELECT 0, label, prediction, count(*) FROM k GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "cv_all_metrics": _tuned_stump(SIGNAL) + f""",
p AS (SELECT param_id, fold, {SIGNAL} AS label, pr.k AS prediction FROM lineitem
      JOIN pr ON l_orderkey % 2 = pr.fold AND pr.lft = (l_discount <= pr.thr)),
l AS (SELECT param_id, fold, label, count(*) AS n, sum((prediction = label)::INT) AS h FROM p GROUP BY ALL),
q AS (SELECT param_id, fold, prediction, count(*) AS m FROM p GROUP BY ALL)
SELECT l.param_id, l.fold::BIGINT AS fold, round(sum(h) / sum(n), 9) AS accuracy,
  round(sum(n * {_F1}) / sum(n), 9) AS weighted_f1, l.param_id = (SELECT param_id FROM won) AS is_best
FROM l LEFT JOIN q ON q.param_id = l.param_id AND q.fold = l.fold AND q.prediction = l.label GROUP BY l.param_id, l.fold""",
    "cv_resumed": _tuned_stump(SIGNAL) + """
SELECT param_id, impurity, round(avg_metric, 9) AS avg_accuracy, round(std_metric, 9) AS std_accuracy,
  2 + (SELECT (impurity = 'gini')::BIGINT FROM won) AS n_fitted, 2 + (SELECT (impurity = 'entropy')::BIGINT FROM won) AS n_reused
FROM avgs""",
    "model_publishing": f"""
SELECT *, 1::BIGINT AS n_left, true AS is_current FROM (
  ({_stump(["l_discount"], SIGNAL, "entropy")} SELECT 'current' AS version, CASE WHEN NOT same THEN round(thr, 9) END AS threshold FROM best, u)
  UNION ALL
  ({_stump(["l_discount"], SIGNAL, "gini")} SELECT 'earlier', CASE WHEN NOT same THEN round(thr, 9) END FROM best, u))""",
    "kfold_stratified": f"""
WITH r AS (SELECT CASE WHEN l_orderkey * 10 + l_linenumber = 11 THEN 'once' ELSE l_quantity::INT::VARCHAR END AS label FROM lineitem),
s AS (SELECT label, count(*) AS n FROM r GROUP BY label UNION ALL SELECT 'all', count(*) FROM r)
SELECT label, n, least(n, {STRATIFIED}) AS n_folds, ceil(n / {STRATIFIED})::BIGINT AS most,
  greatest(n // {STRATIFIED}, 1) AS least_held FROM s""",
    "bootstrap_counts": f"WITH {_RESAMPLED} SELECT * FROM counts",
    "bootstrap_intervals": f"""
WITH {_RESAMPLED},
l AS (SELECT replicate, label, sum(n) AS n, coalesce(sum(n) FILTER (prediction = label), 0) AS h FROM counts GROUP BY ALL),
q AS (SELECT replicate, prediction, sum(n) AS m FROM counts GROUP BY ALL),
v AS (
  SELECT l.replicate, sum(h) / sum(n) AS accuracy, sum(n * {_F1}) / sum(n) AS weighted_f1
  FROM l LEFT JOIN q ON q.replicate = l.replicate AND q.prediction = l.label GROUP BY l.replicate),
w AS (UNPIVOT v ON accuracy, weighted_f1 INTO NAME metric VALUE x)
SELECT metric, round(max(x) FILTER (replicate = 0), 9) AS value, round(stddev(x) FILTER (replicate > 0), 9) AS std,
  round(quantile_cont(x, 0.05) FILTER (replicate > 0), 9) AS low, round(quantile_cont(x, 0.95) FILTER (replicate > 0), 9) AS high,
  count(*) FILTER (replicate > 0) AS n_replicates FROM w GROUP BY metric""",
}

QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        cv_all_metrics,
        cv_resumed,
        model_publishing,
        kfold_stratified,
        bootstrap_counts,
        bootstrap_intervals,
    )
}
