"""The SQL each registered query is checked against, in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Sequence

# Labels of line items, in both dialects. Gini and entropy split the first one at different
# discounts, and the second needs two levels; neither gain shrinks with the data.
SIGNAL = (
    "(CASE WHEN l_discount <= 0.01 OR l_quantity <= CASE WHEN l_discount <= 0.05 THEN 31 ELSE 15 END "
    "THEN 'A' ELSE 'B' END)"
)
SIGNAL_NUMBER = f"(CASE WHEN {SIGNAL} = 'A' THEN 1 ELSE 0 END)"
NESTED = "(CASE WHEN l_discount <= 0.05 THEN 'low' WHEN l_tax <= 0.04 THEN 'mid' ELSE 'high' END)"

IMPURITY = {
    "gini": "1 - sum((n/t)*(n/t))",
    "entropy": "-sum((n/t)*log2(n/t))",
}


def _index(source: str, label: str) -> str:
    """Labels ``k`` of ``source`` with their frequency rank ``id``."""
    return (
        f"SELECT {label} AS k, row_number() OVER (ORDER BY count(*) DESC, {label}::VARCHAR) - 1 AS id "
        f"FROM {source} GROUP BY {label}"
    )


def _stump(
    features: Sequence[str], label: str, impurity: str = "gini", min_share: float | None = None
) -> str:
    """CTEs for the best one-split tree over ``lineitem``.

    ``best`` holds feature, threshold and weighted child impurity, ``pr`` the label
    predicted on each side, ``same`` whether both sides predict the same one.
    """
    source = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS f, {name}::DOUBLE AS v, {label} AS k FROM lineitem"
        for i, name in enumerate(features)
    )
    measure = IMPURITY[impurity]
    having = ""
    if min_share is not None:
        having = f"HAVING min(t) >= ceil({min_share} * (SELECT count(*) FROM lineitem))"
    return f"""WITH c AS (SELECT f, v, k, count(*) AS n FROM ({source}) GROUP BY ALL),
nx AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS w FROM (SELECT DISTINCT f, v FROM c)),
cand AS (SELECT f, (v + w) / 2 AS thr FROM nx WHERE w IS NOT NULL),
side AS (SELECT c.f, thr, c.v <= thr AS lft, k, sum(n)::DOUBLE AS n FROM cand JOIN c ON c.f = cand.f GROUP BY ALL),
tt AS (SELECT *, sum(n) OVER (PARTITION BY f, thr, lft) AS t FROM side),
im AS (SELECT f, thr, lft, any_value(t) AS t, {measure} AS i FROM tt GROUP BY f, thr, lft),
root AS (SELECT {measure} AS i FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY {label})),
best AS (SELECT f, thr, ci FROM (SELECT f, thr, sum(t * i) / sum(t) AS ci FROM im GROUP BY f, thr {having}) ORDER BY round(ci, 12), f, thr LIMIT 1),
idx AS ({_index("lineitem", label)}),
pr AS (SELECT best.f, best.thr, lft, side.k FROM side JOIN best USING (f, thr) JOIN idx ON idx.k = side.k
       QUALIFY row_number() OVER (PARTITION BY lft ORDER BY n DESC, id) = 1),
u AS (SELECT count(DISTINCT k) = 1 AS same FROM pr)
"""


def _two_levels(features: Sequence[str], label: str, impurity: str = "gini") -> str:
    """CTEs that split both sides of the best stump once more.

    ``lines`` tells each row's side of the root, ``pr2`` the label predicted on each side
    of each second split. Thresholds are chosen among those of the whole table.
    """
    chosen = "CASE {}.f " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(features)) + " END"
    source = " UNION ALL ".join(
        f"SELECT node, {i}::BIGINT AS f, {name}::DOUBLE AS v, {label} AS k FROM lines"
        for i, name in enumerate(features)
    )
    return _stump(features, label, impurity) + f""", lines AS (SELECT lineitem.*, {chosen.format("best")} <= best.thr AS node FROM lineitem, best),
c2 AS (SELECT node, f, v, k, count(*) AS n FROM ({source}) GROUP BY ALL),
side2 AS (SELECT node, c2.f, thr, c2.v <= thr AS lft, k, sum(n)::DOUBLE AS n FROM cand JOIN c2 ON c2.f = cand.f GROUP BY ALL),
tt2 AS (SELECT *, sum(n) OVER (PARTITION BY node, f, thr, lft) AS t FROM side2),
im2 AS (SELECT node, f, thr, lft, any_value(t) AS t, {IMPURITY[impurity]} AS i FROM tt2 GROUP BY node, f, thr, lft),
best2 AS (SELECT node, f, thr FROM (SELECT node, f, thr, sum(t * i) / sum(t) AS ci FROM im2 GROUP BY node, f, thr HAVING count(*) = 2)
          QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(ci, 12), f, thr) = 1),
pr2 AS (SELECT node, f, thr, lft, side2.k FROM side2 JOIN best2 USING (node, f, thr) JOIN idx ON idx.k = side2.k
        QUALIFY row_number() OVER (PARTITION BY node, lft ORDER BY n DESC, id) = 1),
leaves AS (SELECT lines.*, pr2.k AS predicted FROM lines JOIN pr2 ON pr2.node = lines.node AND pr2.lft = ({chosen.format("pr2")} <= pr2.thr))
"""


_SPLIT = (
    "CASE WHEN NOT same THEN round(thr, 9) END AS threshold, "
    "CASE WHEN NOT same THEN round((SELECT i FROM root) - ci, 10) END AS gain FROM best, u"
)


def _tuned_stump(label: str) -> str:
    """CTEs for two impurities over the folds ``l_orderkey`` mod 2 on ``l_discount``.

    Fold -1 leaves nothing out: it is the refit on all rows. ``avgs`` holds mean
    and deviation of the accuracy per point, ``won`` the winner, ``pr`` the predictions per fold and point.
    """
    return f"""WITH pts(param_id, impurity) AS (VALUES (0::BIGINT, 'entropy'), (1, 'gini')), folds(fold) AS (VALUES (0), (1), (-1)),
tr AS (SELECT fold, l_discount AS v, {label} AS k, count(*) AS n FROM lineitem JOIN folds ON l_orderkey % 2 <> fold GROUP BY ALL),
nx AS (SELECT fold, v, lead(v) OVER (PARTITION BY fold ORDER BY v) AS w FROM (SELECT DISTINCT fold, v FROM tr)),
cand AS (SELECT fold, (v + w) / 2 AS thr FROM nx WHERE w IS NOT NULL),
side AS (SELECT cand.fold, thr, v <= thr AS lft, k, sum(n)::DOUBLE AS n FROM cand JOIN tr ON tr.fold = cand.fold GROUP BY ALL),
tt AS (SELECT *, sum(n) OVER (PARTITION BY fold, thr, lft) AS t FROM side),
im AS (SELECT fold, thr, lft, param_id, any_value(t) AS t, CASE impurity WHEN 'gini' THEN {IMPURITY["gini"]} ELSE {IMPURITY["entropy"]} END AS i
       FROM tt, pts GROUP BY fold, thr, lft, param_id, impurity),
best AS (SELECT fold, param_id, thr FROM (SELECT fold, param_id, thr, sum(t * i) / sum(t) AS ci FROM im GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY fold, param_id ORDER BY round(ci, 12), thr) = 1),
idx AS ({_index("lineitem", label)}),
pr AS (SELECT best.fold, param_id, best.thr, lft, side.k FROM best JOIN side ON side.fold = best.fold AND side.thr = best.thr JOIN idx ON idx.k = side.k
       QUALIFY row_number() OVER (PARTITION BY best.fold, param_id, lft ORDER BY n DESC, id) = 1),
acc AS (SELECT pr.param_id, pr.fold, avg((pr.k = {label})::INT) AS a FROM lineitem JOIN pr ON l_orderkey % 2 = pr.fold AND pr.lft = (l_discount <= pr.thr) GROUP BY ALL),
avgs AS (SELECT param_id, impurity, avg(a) AS avg_metric, stddev_pop(a) AS std_metric FROM acc JOIN pts USING (param_id) GROUP BY ALL),
won AS (SELECT param_id, impurity FROM avgs ORDER BY avg_metric DESC, param_id LIMIT 1)
"""


_RULED = (
    "SELECT CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END::DOUBLE AS label, "
    "CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_tax > 0.07 THEN 3 ELSE 1 END::DOUBLE AS prediction "
    "FROM lineitem"
)

# Label totals with hits, prediction totals, and the F1 of a label; over a CTE ``p``.
_SIDES = (
    "l AS (SELECT label, count(*) AS n, sum((prediction = label)::INT) AS h FROM p GROUP BY label), "
    "q AS (SELECT prediction, count(*) AS m FROM p GROUP BY prediction)"
)
_F1 = "CASE WHEN h = 0 THEN 0 ELSE 2.0::DOUBLE * h / (n + m) END"
_JOINED = "FROM l LEFT JOIN q ON q.prediction = l.label"
_ACCURACY = "round(avg((prediction = label)::INT), 9)"
_WEIGHTED_F1 = f"round(sum(n * {_F1}) / sum(n), 9)"
_METRICS = (
    f"SELECT 'accuracy' AS metric, {_ACCURACY} AS value FROM p "
    f"UNION ALL SELECT 'weighted_f1', {_WEIGHTED_F1} {_JOINED}"
)

_SCAN = (
    "SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, "
    "l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"
)

_LABELLED = "FROM documents JOIN labels USING (doc_id)"

ORACLES: dict[str, str] = {
    "csv_scan_clean": _SCAN,
    "csv_scan_declared": _SCAN,
    "csv_scan_text": _SCAN,
    "csv_scan_modes": """
SELECT way, o_orderkey::DOUBLE AS o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS is_filled, epoch(o_orderdate) AS placed,
  NULL::DOUBLE AS day, CASE WHEN o_orderkey % 1000 <> 1 THEN (o_orderstatus = 'F')::INT::DOUBLE END AS mixed
FROM orders, (VALUES ('text'), ('inferred')) w(way)""",
    "csv_inferred_schema": """
SELECT 0::BIGINT AS pos, 'l_orderkey' AS name, CASE WHEN max(l_orderkey) < 2147483648 THEN 'int' ELSE 'bigint' END AS type FROM lineitem
UNION ALL SELECT * FROM (VALUES (1, 'l_linenumber', 'int'), (2, 'l_quantity', 'double'), (3, 'l_tax', 'double'), (4, 'l_returnflag', 'string')) t""",
    "clean_cast_double": (
        "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part"
    ),
    "clean_bad_cells": (
        "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size::DOUBLE END AS cell FROM part"
    ),
    "feature_vector_long": (
        "SELECT p_partkey, 0::BIGINT AS pos, p_size::DOUBLE AS value FROM part "
        "UNION ALL SELECT p_partkey, 1, p_retailprice FROM part"
    ),
    "label_index_fit": (
        "SELECT l_returnflag AS label, count(*) AS n, "
        "(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1)::DOUBLE AS idx "
        "FROM lineitem GROUP BY 1"
    ),
    "label_index_ties": (
        "WITH t AS (SELECT (p_partkey % 20)::VARCHAR AS label FROM part) "
        "SELECT label, (row_number() OVER (ORDER BY count(*) DESC, label) - 1)::DOUBLE AS idx "
        "FROM t GROUP BY 1"
    ),
    "label_index_many": (
        "SELECT l_orderkey::VARCHAR AS label, count(*) AS n, (row_number() OVER "
        "(ORDER BY count(*) DESC, l_orderkey::VARCHAR) - 1)::DOUBLE AS idx FROM lineitem GROUP BY l_orderkey"
    ),
    "csv_scan_files": (
        "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part UNION ALL "
        "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.5::DOUBLE END, CASE WHEN p_size % 2 = 0 THEN 2.5::DOUBLE END "
        "FROM part"
    ),
    "score_invalid_rows": (
        "SELECT l_orderkey % 5 = 0 AS has_gap, l_orderkey % 5 = 0 AS missing, count(*) AS n FROM lineitem GROUP BY ALL"
    ),
    "label_index_transform": (
        f"WITH d AS ({_index('orders', 'o_orderpriority')}) "
        "SELECT o_orderkey, id::DOUBLE AS label FROM orders JOIN d ON k = o_orderpriority"
    ),
    "eval_confusion_matrix": (
        f"SELECT label, prediction, count(*) AS n FROM ({_RULED}) GROUP BY ALL"
    ),
    "eval_accuracy": f"SELECT {_ACCURACY} AS accuracy FROM ({_RULED})",
    "eval_per_label": (
        f"WITH p AS ({_RULED}), {_SIDES} SELECT label, n AS n_true, "
        "round(CASE WHEN h = 0 THEN 0 ELSE h::DOUBLE / m END, 9) AS precision_, "
        f"round(h::DOUBLE / n, 9) AS recall_, round({_F1}, 9) AS f1 {_JOINED}"
    ),
    "eval_weighted_f1": f"WITH p AS ({_RULED}), {_SIDES} SELECT {_WEIGHTED_F1} AS weighted_f1 {_JOINED}",
    "metrics_table": f"WITH p AS ({_RULED}), {_SIDES} {_METRICS}",
    "stump_split_gini": _stump(["l_discount"], SIGNAL) + f"SELECT {_SPLIT}",
    "stump_split_entropy": _stump(["l_discount"], SIGNAL, "entropy") + f"SELECT {_SPLIT}",
    "stump_min_instances": (
        _stump(["l_discount"], SIGNAL, "entropy", min_share=0.3) + f"SELECT {_SPLIT}"
    ),
    "stump_best_feature": (
        _stump(["l_linenumber", "l_discount", "l_tax"], SIGNAL)
        + f"SELECT CASE WHEN NOT same THEN f END AS feature, {_SPLIT}"
    ),
    "stump_predict": (
        _stump(["l_discount"], SIGNAL)
        + "SELECT l_orderkey, l_linenumber, l_discount, pr.k AS predicted "
        "FROM lineitem JOIN pr ON pr.lft = (l_discount <= pr.thr)"
    ),
    "tree_predict": (
        _two_levels(["l_linenumber", "l_discount", "l_tax"], SIGNAL)
        + "SELECT l_linenumber, l_discount, l_tax, predicted, count(*) AS n FROM leaves GROUP BY ALL"
    ),
    "param_grid": """
WITH g AS (SELECT row_number() OVER (ORDER BY d, t, s, i) - 1 AS param_id, d AS max_depth, t AS num_trees, 5::BIGINT AS min_instances, s AS seed, i AS impurity
  FROM (VALUES (5::BIGINT), (10)) a(d), (VALUES (50::BIGINT), (150)) b(t), (VALUES (100::BIGINT), (200)) c(s), (VALUES ('entropy'), ('gini')) e(i)),
n AS (SELECT fold, count(*) FILTER (o_orderkey % 2 <> fold) AS n_train, count(*) FILTER (o_orderkey % 2 = fold) AS n_valid
  FROM orders, (VALUES (0::BIGINT), (1)) f(fold) GROUP BY fold)
SELECT * FROM g, n""",
    "kfold_partition": (
        "SELECT way, count(*) AS n_least, count(*) AS n_most, count(*) AS n_validation, 3::BIGINT AS n_balanced "
        "FROM orders, (VALUES ('drawn'), ('hashed')) w(way) GROUP BY way"
    ),
    "kfold_counts": (
        "SELECT o_orderpriority AS label, count(*) AS n, 4::BIGINT AS n_balanced FROM orders GROUP BY ALL"
    ),
    "cv_avg_metrics": (
        _tuned_stump(SIGNAL)
        + "SELECT param_id, impurity, round(avg_metric, 9) AS avg_accuracy, "
        "round(std_metric, 9) AS std_accuracy FROM avgs"
    ),
    "cv_best_point": _tuned_stump(SIGNAL) + "SELECT param_id, impurity FROM won",
    # One split tells a label from the rest, two tell all three of them.
    "cv_random_folds": (
        f"WITH c AS (SELECT count(DISTINCT {NESTED}) AS k FROM lineitem) "
        "SELECT d - 1 AS param_id, d AS max_depth, d + 1 >= k AS is_exact, d + 1 = k AS is_best "
        "FROM c, (VALUES (1::BIGINT), (2)) t(d)"
    ),
    "label_leak_parity": (
        "SELECT l_linenumber::VARCHAR AS predicted, count(*) AS n, count(*) AS n_hit, "
        "2 * count(*) OVER () - 1 AS n_nodes FROM lineitem GROUP BY l_linenumber"
    ),
    "quality_metrics": (
        "SELECT count(*) AS n_held_out, count(*) FILTER (quality = 1) AS n_good, true AS beats_majority "
        f"{_LABELLED} WHERE doc_id % 4 = 0"
    ),
    "model_roundtrip": "SELECT count(*) AS n_rows, 0::BIGINT AS n_mismatch FROM lineitem",
    "forest_fit_score": (
        "SELECT count(*) AS n_rows, count(*) AS n_prob_ok, count(*) AS n_label_ok, true AS has_learnt "
        f"{_LABELLED}"
    ),
    "forest_tree_nodes": (
        "SELECT tree_id, count(*) AS n_rows, 1::BIGINT AS n_excess, 0::BIGINT AS n_bad, 0::BIGINT AS n_small "
        f"{_LABELLED}, range(20) t(tree_id) GROUP BY tree_id"
    ),
    "score_unlabelled": (
        _stump(["l_discount"], SIGNAL)
        + "SELECT pr.k AS predicted, false AS has_label, count(*) AS n "
        "FROM lineitem JOIN pr ON pr.lft = (l_discount <= pr.thr) GROUP BY ALL"
    ),
    "train_then_score": (
        _tuned_stump(SIGNAL_NUMBER)
        + f", p AS (SELECT {SIGNAL_NUMBER} AS label, pr.k AS prediction FROM lineitem "
        "JOIN pr ON pr.fold = -1 AND pr.lft = (l_discount <= pr.thr) JOIN won USING (param_id)), "
        f"{_SIDES} {_METRICS}"
    ),
}
