"""Every registered query against its SQL: names, types, rows as a multiset."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tabgrove.operators.folds import FOLD_COL
from tabgrove.operators.forest import build_forest
from tabgrove.plans import queries
from tabgrove.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(QUERIES) == set(ORACLES)


def _constant(**params):
    return build_forest(**{**params, "maxDepth": 0})


def _one_fold(df, num_folds=2, seed=0, keys=None, fold_col=FOLD_COL):
    return df.withColumn(fold_col, F.lit(0))


def _first_point(trials):
    return trials.orderBy("param_id").limit(1)


BROKEN = [
    ("forest_fit_score", "build_forest", _constant),
    ("quality_metrics", "build_forest", _constant),
    ("label_leak_parity", "build_forest", _constant),
    ("kfold_partition", "assign_folds", _one_fold),
    ("kfold_counts", "assign_folds", _one_fold),
    ("cv_best_point", "best_trial", _first_point),
]


@pytest.mark.parametrize("name, operator, broken", BROKEN)
def test_sql_sees_a_broken_operator(name, operator, broken, spark, sf_dir, duck, monkeypatch):
    monkeypatch.setattr(queries, operator, broken)
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    expected = duck.sql(ORACLES[name]).select(", ".join(columns)).fetchall()
    assert sorted(map(tuple, result.select(*columns).collect())) != sorted(expected)


SPARK_TYPES = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "boolean": "BOOLEAN",
}


# Physical operators that leave the JVM or pair all rows with all rows.
UNWANTED = ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    result = QUERIES[name](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in UNWANTED if operator in plan]
    expected = duck.sql(ORACLES[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)

    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: SPARK_TYPES[t] for c, t in result.dtypes} == types

    def key(row):
        return [(v is not None, v) for v in row]

    actual_rows = sorted((tuple(row[c] for c in columns) for row in result.collect()), key=key)
    order = [expected.columns.index(c) for c in columns]
    expected_rows = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=key)
    assert actual_rows == expected_rows
    assert actual_rows


# Queries that score with a forest as it was fitted, to two labels.
FITTED = ["stump_predict", "tree_predict", "forest_fit_score", "quality_metrics"]


@pytest.mark.parametrize("name", FITTED)
def test_query_scores_after_an_observation(name, spark, sf_dir, duck):
    """No task can be sent a session that has observed something."""
    spark.range(3).observe(Observation(), F.count("*").alias("n")).collect()
    test_query_matches_sql(name, spark, sf_dir, duck)
