"""Every operator as a query over the given tables: ``(spark, folder) -> DataFrame``.

``oracles.py`` holds the SQL each one is checked against.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgrove.operators.clean import clean_columns
from tabgrove.operators.evaluate import (
    accuracy,
    confusion_matrix,
    metrics_table,
    per_label,
    weighted_f1,
)
from tabgrove.operators.features import assemble_long
from tabgrove.operators.folds import assign_folds, fold_counts, training_rows, validation_rows
from tabgrove.operators.forest import build_forest, fit_pipeline
from tabgrove.operators.labels import apply_label_index, fit_label_index, label_table
from tabgrove.operators.score import pipeline_forest, pipeline_labels, score_batch
from tabgrove.operators.tune import Tuning, best_trial, grid_points
from tabgrove.plans.jobs import evaluate_job, read_clean, score_job, train_classifier
from tabgrove.plans.oracles import NESTED, SIGNAL, SIGNAL_NUMBER
from tabgrove.sources.delimited import inferred_types, read_delimited
from tabgrove.sources.models import load_model, save_model, tree_nodes
from tabgrove.sources.shared import lay_out, materialise, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows a task of a fit reads. The layout follows the data, never the number of cores.
ROWS_PER_PARTITION = 100_000


def laid_out(df: DataFrame) -> DataFrame:
    return lay_out(df, -(-df.count() // ROWS_PER_PARTITION) or 1)


def stump(**params):
    """A one-split tree over all rows and features, whose best split has a closed form."""
    settings = {"maxDepth": 1, "impurity": "gini", "seed": 1, **params}
    return build_forest(numTrees=1, bootstrap=False, featureSubsetStrategy="all", **settings)


# --- delimited scans and cleaning -------------------------------------------------------

SCAN_COLUMNS = [
    "l_orderkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def damaged_csv(df: DataFrame) -> str:
    """Write ``df`` as semicolon text whose header names carry extra quotes; its path."""
    path = shared_folder(df.sparkSession)
    named = df.toDF(*(f'""{name}"""' for name in df.columns))
    named.write.option("header", True).option("sep", ";").csv(path)
    return path


def lines_with_header(lines: DataFrame, header: str) -> str:
    """Write the one text column of ``lines`` as files that each begin with ``header``."""
    path = shared_folder(lines.sparkSession)
    # No line holds this separator or this quote, so lines are written as they are.
    writer = lines.toDF(header).write.option("header", True).option("sep", "\x01").option("quote", "\x02")
    writer.csv(path)
    return path


def csv_scan_clean(spark, sf_dir):
    path = damaged_csv(table(spark, sf_dir, "lineitem").select(*SCAN_COLUMNS))
    return read_clean(spark, path, infer_schema=True)


def csv_scan_declared(spark, sf_dir):
    """The same scan with the types given: no inference pass, header checked."""
    source = table(spark, sf_dir, "lineitem").select(*SCAN_COLUMNS)
    return read_clean(spark, damaged_csv(source), schema=source.schema)


def csv_scan_text(spark, sf_dir):
    """The same scan as text, cast where it is read."""
    path = damaged_csv(table(spark, sf_dir, "lineitem").select(*SCAN_COLUMNS))
    return read_clean(spark, path, on_bad_cell="fail")


def csv_scan_modes(spark, sf_dir):
    """Booleans, timestamps, dates and a column with odd cells: as text and inferred."""
    placed = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("is_filled"),
        F.date_format(placed, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("placed"),
        F.date_format(placed, "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderkey") % 1000 == 1, "odd").otherwise((F.col("o_orderstatus") == "F").cast("string")).alias("mixed"),
    )
    path = damaged_csv(orders)
    ways = {"text": False, "inferred": True}
    return reduce(
        DataFrame.unionByName,
        (read_clean(spark, path, infer_schema=way).withColumn("way", F.lit(name)) for name, way in ways.items()),
    )


def csv_scan_files(spark, sf_dir):
    """Two folders of files with one header, and one of files whose rows are all too short
    or too long: missing cells are NULL, and cells without a name are left out."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    cells = F.concat_ws(";", "p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit("1.5;2.5;9")))
    ragged = lines_with_header(rows.select(cells.alias("line")), "p_partkey;p_size;p_retailprice")
    halves = [damaged_csv(rows.where(f"p_partkey % 2 = {i}")) for i in (0, 1)]
    return read_clean(spark, halves).unionByName(read_clean(spark, ragged))


def csv_inferred_schema(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag"
    )
    return inferred_types(read_delimited(spark, damaged_csv(source)))


def clean_cast_double(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return clean_columns(part.toDF(*(f'"""{name}""' for name in part.columns)))


def clean_bad_cells(spark, sf_dir):
    cell = F.when(F.col("p_size") % 10 == 0, F.col("p_type"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", cell.otherwise(F.col("p_size").cast("string")).alias('"cell"')
    )
    return clean_columns(part).withColumn("p_partkey", F.col("p_partkey").cast("long"))


# --- features and labels ----------------------------------------------------------------


def feature_vector_long(spark, sf_dir):
    rows = assemble_long(
        table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"]
    )
    return rows.withColumn("pos", F.col("pos").cast("long"))


def label_index_fit(spark, sf_dir):
    return label_table(table(spark, sf_dir, "lineitem"), "l_returnflag")


def label_index_ties(spark, sf_dir):
    """Labels that occur equally often, as numbers whose text sorts differently."""
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("key"))
    return label_table(keys, "key").select("label", "idx")


def label_index_many(spark, sf_dir):
    """As many labels as there are orders, most of them tied."""
    return label_table(table(spark, sf_dir, "lineitem"), "l_orderkey")


def label_index_transform(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    indexed = apply_label_index(orders, fit_label_index(orders, "o_orderpriority"))
    return indexed.select("o_orderkey", "label")


# --- evaluation -------------------------------------------------------------------------


def ruled(spark, sf_dir) -> DataFrame:
    """Line items with a label and a rule's prediction: label 2 is never predicted and
    prediction 3 is never a label."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2)
    rule = F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_tax") > 0.07, 3).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        label.cast("double").alias("label"), rule.cast("double").alias("prediction")
    )


def eval_confusion_matrix(spark, sf_dir):
    return confusion_matrix(ruled(spark, sf_dir))


def eval_accuracy(spark, sf_dir):
    return accuracy(ruled(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"))


def eval_per_label(spark, sf_dir):
    return per_label(confusion_matrix(ruled(spark, sf_dir))).select(
        "label",
        "n_true",
        F.round("precision", 9).alias("precision_"),
        F.round("recall", 9).alias("recall_"),
        F.round("f1", 9).alias("f1"),
    )


def eval_weighted_f1(spark, sf_dir):
    f1 = weighted_f1(ruled(spark, sf_dir))
    return f1.select(F.round("weighted_f1", 9).alias("weighted_f1"))


def eval_metrics_table(spark, sf_dir):
    metrics = metrics_table(ruled(spark, sf_dir))
    return metrics.withColumn("value", F.round("value", 9))


# --- trees, with exact expectations -----------------------------------------------------

STUMP_FEATURES = ["l_linenumber", "l_discount", "l_tax"]


def labelled_items(spark, sf_dir) -> DataFrame:
    """Line items with a label, ``kind``, that follows from discount and quantity."""
    return table(spark, sf_dir, "lineitem").withColumn("kind", F.expr(SIGNAL))


def root_split(spark, sf_dir, features: list[str], forest) -> DataFrame:
    """Fit, save, and read the root of the first tree back from the node table."""
    path = shared_folder(spark)
    rows = laid_out(labelled_items(spark, sf_dir).select(*features, "kind"))
    save_model(fit_pipeline(rows, "kind", forest, features), path)
    root = tree_nodes(spark, path).filter("tree_id = 0 AND node_id = 0")
    return root.select(
        "feature", F.round("threshold", 9).alias("threshold"), F.round("gain", 10).alias("gain")
    )


def stump_split_gini(spark, sf_dir):
    split = root_split(spark, sf_dir, ["l_discount"], stump())
    return split.select("threshold", "gain")


def stump_split_entropy(spark, sf_dir):
    split = root_split(spark, sf_dir, ["l_discount"], stump(impurity="entropy"))
    return split.select("threshold", "gain")


def stump_min_instances(spark, sf_dir):
    """Each side must hold 30% of the rows, which refuses the unconstrained winner. The
    least number of rows a node may have is checked by ``forest_tree_nodes``."""
    forest = stump(impurity="entropy", minWeightFractionPerNode=0.3)
    return root_split(spark, sf_dir, ["l_discount"], forest).select("threshold", "gain")


def stump_best_feature(spark, sf_dir):
    """The best split among three features, read from the node table."""
    return root_split(spark, sf_dir, STUMP_FEATURES, stump())


def stump_predict(spark, sf_dir):
    rows = labelled_items(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_discount", "kind"
    )
    model = fit_pipeline(laid_out(rows.select("l_discount", "kind")), "kind", stump(), ["l_discount"])
    return score_batch(model, rows).select(
        "l_orderkey", "l_linenumber", "l_discount", "predicted"
    )


def tree_predict(spark, sf_dir):
    """A tree of two levels over three features: rows per feature values and prediction."""
    rows = labelled_items(spark, sf_dir).select(*STUMP_FEATURES, "kind")
    model = fit_pipeline(laid_out(rows), "kind", stump(maxDepth=2), STUMP_FEATURES)
    return (
        score_batch(model, rows)
        .groupBy(*STUMP_FEATURES, "predicted")
        .agg(F.count("*").alias("n"))
    )


# --- grid, folds, cross-validation ------------------------------------------------------


def param_grid(spark, sf_dir):
    """The default grid over two folds of the orders: rows each fit trains and is tested on."""
    folds = (0, 1)
    fold = F.col("o_orderkey") % 2
    sizes = table(spark, sf_dir, "orders").agg(
        *(F.count_if(fold != f).alias(f"train_{f}") for f in folds),
        *(F.count_if(fold == f).alias(f"valid_{f}") for f in folds),
    )
    fits = [
        F.struct(
            F.lit(point["param_id"]).cast("long").alias("param_id"),
            F.lit(point["maxDepth"]).cast("long").alias("max_depth"),
            F.lit(point["numTrees"]).cast("long").alias("num_trees"),
            F.lit(point["minInstancesPerNode"]).cast("long").alias("min_instances"),
            F.lit(point["seed"]).cast("long").alias("seed"),
            F.lit(point["impurity"]).alias("impurity"),
            F.lit(f).cast("long").alias("fold"),
            F.col(f"train_{f}").alias("n_train"),
            F.col(f"valid_{f}").alias("n_valid"),
        )
        for point in grid_points(build_forest())
        for f in folds
    ]
    return sizes.select(F.inline(F.array(*fits)))


def balanced(part, whole, folds: int):
    """Whether a fold's part of independently dealt rows is within six deviations."""
    return F.abs(part - whole / folds) <= 6 * F.sqrt(whole * (folds - 1)) / folds


def kfold_partition(spark, sf_dir):
    """Folds drawn with a seed and folds hashed from a key: the two sides of every fold
    make up all rows, the folds' validation rows do so too, and all folds are about equal."""
    orders, folds = table(spark, sf_dir, "orders").select("o_orderkey"), 3
    ways = {
        "drawn": materialise(assign_folds(orders, folds, seed=7)),
        "hashed": assign_folds(orders, folds, seed=7, keys=["o_orderkey"]),
    }
    sides = [
        rows(folded, fold).agg(F.count("*").alias("n")).select(
            F.lit(way).alias("way"), F.lit(fold).alias("fold"), F.lit(is_valid).alias("is_valid"), "n"
        )
        for way, folded in ways.items()
        for fold in range(folds)
        for rows, is_valid in ((training_rows, False), (validation_rows, True))
    ]
    per_fold = (
        reduce(DataFrame.unionByName, sides)
        .groupBy("way", "fold")
        .agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("is_valid"), F.col("n"))).alias("n_valid"))
    )
    return per_fold.groupBy("way").agg(
        F.min("n_rows").alias("n_least"),
        F.max("n_rows").alias("n_most"),
        F.sum("n_valid").alias("n_validation"),
        F.count_if(balanced(F.col("n_valid"), F.col("n_rows"), folds)).alias("n_balanced"),
    )


def kfold_counts(spark, sf_dir):
    """Orders of each priority over four hashed folds: all of them, in about equal parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    counts = fold_counts(assign_folds(orders, 4, seed=7, keys=["o_orderkey"]), "o_orderpriority")
    folded = counts.groupBy("label").agg(F.sum("n").alias("n"), F.collect_list("n").alias("parts"))
    within = F.filter("parts", lambda part: balanced(part, F.col("n"), 4))
    return folded.select("label", "n", F.size(within).cast("long").alias("n_balanced"))


def tuned_stump(rows: DataFrame, label: str) -> Tuning:
    """Two grid points over the folds ``l_orderkey`` mod 2; the second one wins."""
    return train_classifier(
        rows.withColumn("fold", F.col("l_orderkey") % 2),
        label,
        features=["l_discount"],
        forest=stump(),
        grid={"impurity": ["entropy", "gini"]},
        fold_col="fold",
        parallelism=2,
    )


def cv_avg_metrics(spark, sf_dir):
    trials = tuned_stump(labelled_items(spark, sf_dir), "kind").trials
    return trials.select(
        "param_id",
        "impurity",
        F.round("avg_metric", 9).alias("avg_accuracy"),
        F.round("std_metric", 9).alias("std_accuracy"),
    )


def cv_best_point(spark, sf_dir):
    trials = tuned_stump(labelled_items(spark, sf_dir), "kind").trials
    return best_trial(trials).select("param_id", "impurity")


def cv_random_folds(spark, sf_dir):
    """Tuning over drawn folds, of a label that only the second point's depth can tell."""
    rows = table(spark, sf_dir, "lineitem").select("l_discount", "l_tax", F.expr(NESTED).alias("kind"))
    tuned = train_classifier(
        rows, "kind", forest=stump(), grid={"maxDepth": [1, 2]}, num_folds=3, seed=5, parallelism=2
    )
    return tuned.trials.select(
        "param_id",
        F.col("maxDepth").alias("max_depth"),
        (F.col("avg_metric") == 1).alias("is_exact"),
        (F.col("param_id") == tuned.best["param_id"]).alias("is_best"),
    )


# --- forests, persistence, whole jobs ---------------------------------------------------


def model_roundtrip(spark, sf_dir):
    """Save and load a forest, score every line item with both, count differences."""
    rows = table(spark, sf_dir, "lineitem").select(*STUMP_FEATURES, "l_returnflag")
    forest = build_forest(numTrees=5, maxDepth=5, seed=1)
    fitted = fit_pipeline(laid_out(rows), "l_returnflag", forest, STUMP_FEATURES)
    path = shared_folder(spark)
    save_model(fitted, path)

    def scored(model: PipelineModel, df: DataFrame, suffix: str) -> DataFrame:
        out = model.transform(df)
        return out.withColumns(
            {
                f"prediction_{suffix}": F.col("prediction"),
                f"probability_{suffix}": vector_to_array("probability"),
            }
        ).drop("features", "label", "rawPrediction", "probability", "prediction")

    both = scored(load_model(path), scored(fitted, rows, "a"), "b")
    differs = (F.col("prediction_a") != F.col("prediction_b")) | (
        F.col("probability_a") != F.col("probability_b")
    )
    return both.agg(F.count("*").alias("n_rows"), F.count_if(differs).alias("n_mismatch"))


TEXT_FEATURES = ["n_words", "n_lines", "n_chars", "distinct_share", "capital_share", "mark_share"]


def labelled_texts(spark, sf_dir) -> DataFrame:
    """Features of whole texts with their quality label: lengths, and the shares of
    distinct words, capitals and marks. Texts are reduced to these numbers before the
    join, so no text is shuffled."""
    words = F.split("text", r"\s+")

    def share(unlike: str):
        return F.length(F.regexp_replace("text", unlike, "")) / F.greatest(F.length("text"), F.lit(1))

    sizes = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(words).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.length("text").cast("double").alias("n_chars"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
        share(r"\P{Lu}").alias("capital_share"),
        share(r"[\p{L}\p{N}\s]").alias("mark_share"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sizes.join(labels, "doc_id")


def text_forest(rows: DataFrame, **params) -> PipelineModel:
    forest = build_forest(numTrees=20, maxDepth=5, seed=1, **params)
    return fit_pipeline(rows, "quality", forest, TEXT_FEATURES)


def beats_majority():
    """Whether more of the scored texts are right than if all got the commoner label."""
    good, hits = F.count_if(F.col("quality") == 1), F.count_if(F.col("predicted") == F.col("quality").cast("string"))
    return hits > F.greatest(good, F.count("*") - good)


def forest_fit_score(spark, sf_dir):
    """Probabilities add up to 1, labels are known ones, and the forest has learnt."""
    rows = materialise(labelled_texts(spark, sf_dir))
    model = text_forest(rows)
    scored = score_batch(model, rows)
    total = F.aggregate("probability", F.lit(0.0).cast("double"), lambda acc, p: acc + p)
    known = F.col("predicted").isin(pipeline_labels(model))
    return scored.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_prob_ok"),
        F.count_if(known).alias("n_label_ok"),
        beats_majority().alias("has_learnt"),
    )


# The least number of rows a node may have.
NODE_ROWS = 7


def forest_tree_nodes(spark, sf_dir):
    """The node table of a saved forest without bootstrap: the leaves of every tree hold
    all rows between them, there is one leaf more than there are splits, and none is small."""
    path = shared_folder(spark)
    rows = materialise(labelled_texts(spark, sf_dir))
    save_model(text_forest(rows, bootstrap=False, minInstancesPerNode=NODE_ROWS), path)
    is_leaf = F.col("left_child") == -1
    return (
        tree_nodes(spark, path)
        .groupBy("tree_id")
        .agg(
            F.sum(F.when(is_leaf, F.col("n_rows"))).alias("n_rows"),
            (F.count_if(is_leaf) - F.count_if(~is_leaf)).alias("n_excess"),
            F.count_if(is_leaf == F.col("threshold").isNotNull()).alias("n_bad"),
            F.count_if(F.col("n_rows") < NODE_ROWS).alias("n_small"),
        )
    )


def label_leak_parity(spark, sf_dir):
    """A label among its own features, as the caller may insist on: every row is told
    right by a tree that has one leaf for each label."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_discount")
    model = fit_pipeline(
        laid_out(rows), "l_linenumber", stump(maxDepth=6), ["l_discount", "l_linenumber"], allow_label_feature=True
    )
    hit = F.col("predicted") == F.col("l_linenumber").cast("string")
    return score_batch(model, rows).groupBy("predicted").agg(
        F.count("*").alias("n"),
        F.count_if(hit).alias("n_hit"),
        F.lit(pipeline_forest(model).totalNumNodes).cast("long").alias("n_nodes"),
    )


def score_unlabelled(spark, sf_dir):
    """Score a table without its label column: predictions per line item, no label."""
    rows = labelled_items(spark, sf_dir).select("l_orderkey", "l_discount", "kind")
    path = shared_folder(spark)
    sides = laid_out(rows.select("l_discount", "kind"))
    save_model(fit_pipeline(sides, "kind", stump(), ["l_discount"]), path)
    unlabelled = damaged_csv(rows.select("l_orderkey", "l_discount"))
    scored = score_job(spark, unlabelled, path)
    return scored.groupBy(
        "predicted", F.lit("label" in scored.columns).alias("has_label")
    ).agg(F.count("*").alias("n"))


def score_invalid_rows(spark, sf_dir):
    """Rows without a feature keep their place in the scores, without a prediction."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_returnflag")
    gaps = F.when(F.col("l_orderkey") % 5 > 0, F.col("l_discount"))
    model = fit_pipeline(rows, "l_returnflag", stump(), ["l_discount"], handle_invalid="skip")
    scored = score_batch(model, rows.withColumn("l_discount", gaps))
    missing = F.col("predicted").isNull()
    return scored.groupBy((F.col("l_orderkey") % 5 == 0).alias("has_gap"), missing.alias("missing")).agg(
        F.count("*").alias("n")
    )


def train_then_score(spark, sf_dir):
    """Both jobs end to end: text with a damaged header, clean, tune, save; then load,
    score and evaluate the same text."""
    source = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_discount", F.expr(SIGNAL_NUMBER).alias("kind")
    )
    text = damaged_csv(source)
    model = shared_folder(spark)
    trained = tuned_stump(read_clean(spark, text), "kind")
    save_model(trained.model, model)
    metrics = evaluate_job(spark, text, model)
    return metrics.withColumn("value", F.round("value", 9))


def quality_metrics(spark, sf_dir):
    """Train on three quarters of the labelled texts, by key, and score the rest."""
    rows = materialise(labelled_texts(spark, sf_dir).withColumn("fold", F.col("doc_id") % 4))
    scored = score_batch(text_forest(training_rows(rows, 0, "fold")), validation_rows(rows, 0, "fold"))
    return scored.agg(
        F.count("*").alias("n_held_out"),
        F.count_if(F.col("quality") == 1).alias("n_good"),
        beats_majority().alias("beats_majority"),
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        csv_scan_clean,
        csv_scan_declared,
        csv_scan_text,
        csv_scan_modes,
        csv_scan_files,
        csv_inferred_schema,
        clean_cast_double,
        clean_bad_cells,
        feature_vector_long,
        label_index_fit,
        label_index_ties,
        label_index_many,
        label_index_transform,
        eval_confusion_matrix,
        eval_accuracy,
        eval_per_label,
        eval_weighted_f1,
        stump_split_gini,
        stump_split_entropy,
        stump_min_instances,
        stump_best_feature,
        stump_predict,
        tree_predict,
        param_grid,
        kfold_partition,
        kfold_counts,
        cv_avg_metrics,
        cv_best_point,
        cv_random_folds,
        model_roundtrip,
        forest_fit_score,
        forest_tree_nodes,
        label_leak_parity,
        score_unlabelled,
        score_invalid_rows,
        train_then_score,
        quality_metrics,
    )
}
QUERIES["metrics_table"] = eval_metrics_table
