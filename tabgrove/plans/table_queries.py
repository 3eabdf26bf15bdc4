"""Queries over tables before and beside training: bad rows, types, leaks, lookups, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabgrove.operators.evaluate import metrics_table
from tabgrove.operators.labels import label_table
from tabgrove.operators.leaks import leak_report
from tabgrove.operators.lookup import with_index, with_label
from tabgrove.operators.profile import profile_columns, profiled_types
from tabgrove.plans.oracles import _METRICS, _RULED, _SIDES, _index
from tabgrove.plans.queries import Query, damaged_csv, lines_with_header, ruled, table
from tabgrove.sources.delimited import read_delimited
from tabgrove.sources.metrics import read_metrics, write_metrics
from tabgrove.sources.quarantine import read_checked, reason_counts, write_split
from tabgrove.sources.shared import shared_folder


def ragged_parts(spark, sf_dir) -> str:
    """All parts as text. Of seven in a row one lacks a cell, one has two more, one has a
    word for its size, one both, and one a price that is quoted and no number."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    kind = F.col("p_partkey") % 7
    line = (
        F.when(kind == 0, F.concat_ws(";", key, size))
        .when(kind == 1, F.concat_ws(";", key, size, price, F.lit("7"), F.lit("")))
        .when(kind == 2, F.concat_ws(";", key, F.lit("large"), price))
        .when(kind == 3, F.concat_ws(";", key, F.lit("large"), price, F.lit("7")))
        .when(kind == 4, F.concat_ws(";", key, size, F.lit('"1;5"')))
        .otherwise(F.concat_ws(";", key, size, price))
    )
    return lines_with_header(table(spark, sf_dir, "part").select(line.alias("line")), "p_partkey;p_size;p_retailprice")


def csv_quarantine(spark, sf_dir):
    """Every row of the parts' text: the good ones' numbers, the bad ones' lines and
    reasons, both from one scan."""
    good, bad = write_split(read_checked(spark, ragged_parts(spark, sf_dir)), shared_folder(spark))
    placed = F.col("file").endswith(".csv") & (F.col("block_start") >= 0) & (F.col("place") >= 0)
    bad = bad.select("line", F.array_join("reasons", ", ").alias("reason"), placed.alias("is_placed"))
    return good.unionByName(bad, allowMissingColumns=True)


def csv_bad_reasons(spark, sf_dir):
    """Bad rows of the parts' text by what is wrong with them."""
    checked = read_checked(spark, ragged_parts(spark, sf_dir))
    _, bad = write_split(checked, shared_folder(spark))
    return reason_counts(bad).groupBy("reason").agg(F.sum("n").alias("n"))


def csv_type_profile(spark, sf_dir):
    """Type, gaps, cells that are no numbers, and extremes of each column of line items as
    text: odd cells make a number column text, gaps change no type."""
    ship = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("decimal(12,2)").alias("l_quantity"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_tax")).alias("gaps"),
        F.when(F.col("l_linenumber") == 2, "odd").otherwise(F.col("l_linenumber").cast("string")).alias("odd"),
        # As decimals: a bigint holds the product of less than a million orders only.
        (F.col("l_orderkey").cast("decimal(19,0)") * 10_000_000_000_000).alias("big"),
        ship.alias("shipped"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("moment"),
        (F.col("l_returnflag") == "R").alias("is_returned"),
        "l_returnflag",
    )
    profile = profile_columns(read_delimited(spark, damaged_csv(rows), infer_schema=False))
    is_text = F.col("type") == "string"
    out = profiled_types(profile)
    return out.withColumns({name: F.when(is_text, F.col(name)) for name in ("first_text", "last_text")})


def feature_leaks(spark, sf_dir):
    """What each feature alone decides of the line number, which is among the features."""
    features = ["l_discount", "l_linenumber", "l_tax", "l_extendedprice"]
    report = leak_report(table(spark, sf_dir, "lineitem"), "l_linenumber", features)
    return report.withColumn("share", F.round("share", 9))


def label_lookup_many(spark, sf_dir):
    """As many labels as there are orders, looked up both ways for every line item: the
    index of its order, and the order whose index is the even one of the pair."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    labels = label_table(items, "l_orderkey")
    indexed = with_index(items, "l_orderkey", labels)
    ruled_ = indexed.withColumn("prediction", F.col("label") - F.col("label") % 2)
    return with_label(ruled_, "prediction", labels)


def metrics_sink(spark, sf_dir):
    """Metrics of two batches, the first one written twice, as a retried job does."""
    path = shared_folder(spark)
    metrics = metrics_table(ruled(spark, sf_dir)).withColumn("value", F.round("value", 9))
    for batch in ("first", "second", "first"):
        write_metrics(metrics, path, "rule", batch)
    return read_metrics(spark, path)


_KINDS = "p_partkey % 7 AS kind, p_partkey::VARCHAR || ';' AS k, p_size::VARCHAR AS s, p_retailprice::DECIMAL(12, 2)::VARCHAR AS p"
_REASON = """CASE kind WHEN 0 THEN '2 cells instead of 3' WHEN 1 THEN '5 cells instead of 3'
    WHEN 2 THEN 'not a number in column p_size: large' WHEN 3 THEN '4 cells instead of 3, not a number in column p_size: large'
    WHEN 4 THEN 'not a number in column p_retailprice: 1;5' END"""

ORACLES: dict[str, str] = {
    "csv_quarantine": f"""
SELECT CASE WHEN kind > 4 THEN p_partkey::DOUBLE END AS p_partkey, CASE WHEN kind > 4 THEN p_size::DOUBLE END AS p_size,
  CASE WHEN kind > 4 THEN p::DOUBLE END AS p_retailprice,
  CASE kind WHEN 0 THEN k || s WHEN 1 THEN k || s || ';' || p || ';7;' WHEN 2 THEN k || 'large;' || p
    WHEN 3 THEN k || 'large;' || p || ';7' WHEN 4 THEN k || s || ';1;5' END AS line,
  {_REASON} AS reason, CASE WHEN kind < 5 THEN true END AS is_placed
FROM (SELECT *, {_KINDS} FROM part)""",
    "csv_bad_reasons": f"""
SELECT trim(split_part(r, ': ', 1)) AS reason, count(*) AS n
FROM (SELECT unnest(string_split({_REASON}, ', ')) AS r FROM (SELECT *, {_KINDS} FROM part)) GROUP BY 1""",
    "csv_type_profile": """
WITH t AS (SELECT *, CASE WHEN l_linenumber % 3 > 0 THEN l_tax END AS gap, l_orderkey::DOUBLE * 1e13 AS b FROM lineitem),
r AS (
  SELECT 0::BIGINT AS pos, 'l_orderkey' AS name, CASE WHEN max(l_orderkey) < 2147483648 THEN 'int' ELSE 'bigint' END AS type,
    0::BIGINT AS n_null, 0::BIGINT AS n_bad, min(l_orderkey)::DOUBLE AS least, max(l_orderkey)::DOUBLE AS greatest FROM t
  UNION ALL SELECT 1, 'l_linenumber', 'int', 0, 0, min(l_linenumber), max(l_linenumber) FROM t
  UNION ALL SELECT 2, 'l_quantity', 'double', 0, 0, min(l_quantity), max(l_quantity) FROM t
  UNION ALL SELECT 3, 'gaps', 'double', count(*) - count(gap), 0, min(gap), max(gap) FROM t
  UNION ALL SELECT 4, 'odd', 'string', 0, count(*) FILTER (l_linenumber = 2),
    min(l_linenumber) FILTER (l_linenumber <> 2), max(l_linenumber) FILTER (l_linenumber <> 2) FROM t
  UNION ALL SELECT 5, 'big', 'bigint', 0, 0, min(b), max(b) FROM t
  UNION ALL SELECT 6, 'shipped', 'date', 0, count(*), NULL, NULL FROM t
  UNION ALL SELECT 7, 'moment', 'timestamp', 0, 0, epoch(min(l_shipdate)), epoch(max(l_shipdate)) FROM t
  UNION ALL SELECT 8, 'is_returned', 'boolean', 0, 0, min((l_returnflag = 'R')::INT), max((l_returnflag = 'R')::INT) FROM t
  UNION ALL SELECT 9, 'l_returnflag', 'string', 0, count(*), NULL, NULL FROM t)
SELECT r.*, n AS n_rows,
  CASE name WHEN 'odd' THEN (SELECT min(l_linenumber)::VARCHAR FROM t WHERE l_linenumber <> 2) WHEN 'l_returnflag' THEN low END AS first_text,
  CASE name WHEN 'odd' THEN 'odd' WHEN 'l_returnflag' THEN high END AS last_text
FROM r, (SELECT count(*) AS n, min(l_returnflag) AS low, max(l_returnflag) AS high FROM t)""",
    "feature_leaks": """
WITH h AS (
  SELECT feature, value, sum(n) AS n, max(n) AS most FROM (
    SELECT x.f AS feature, x.v AS value, l_linenumber, count(*) AS n FROM (
      SELECT l_linenumber, unnest([{'f': 'l_discount', 'v': l_discount}, {'f': 'l_linenumber', 'v': l_linenumber::DOUBLE},
        {'f': 'l_tax', 'v': l_tax}, {'f': 'l_extendedprice', 'v': l_extendedprice}]) AS x FROM lineitem)
    GROUP BY ALL) GROUP BY ALL),
r AS (
  SELECT feature, count(*) AS n_values, sum(n)::BIGINT AS n_rows, sum(most)::BIGINT AS n_decided,
    coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_repeated,
    coalesce(sum(most) FILTER (n > 1), 0)::BIGINT AS n_decided_repeated FROM h GROUP BY feature),
s AS (SELECT *, CASE WHEN n_repeated > 0 THEN n_decided_repeated::DOUBLE / n_repeated ELSE 0 END AS q FROM r)
SELECT * EXCLUDE q, round(q, 9) AS share, q >= 0.99 AND 2 * n_repeated > n_rows AS is_leak FROM s""",
    "label_lookup_many": f"""
WITH d AS ({_index("lineitem", "l_orderkey")})
SELECT l_orderkey, l_linenumber, a.id::DOUBLE AS label, (a.id - a.id % 2)::DOUBLE AS prediction, b.k::VARCHAR AS predicted
FROM lineitem JOIN d a ON a.k = l_orderkey JOIN d b ON b.id = a.id - a.id % 2""",
    "metrics_sink": f"""
WITH p AS ({_RULED}), {_SIDES}, m AS ({_METRICS})
SELECT metric, value, 'rule' AS model, batch FROM m, (VALUES ('first'), ('second')) b(batch)""",
}

QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        csv_quarantine,
        csv_bad_reasons,
        csv_type_profile,
        feature_leaks,
        label_lookup_many,
        metrics_sink,
    )
}
