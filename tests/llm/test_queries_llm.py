"""Registered queries of the package against SQL, and the pipeline against its own rules."""

from __future__ import annotations

import glob
import os

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tabgrove.llm.oracles import ORACLES
from tabgrove.llm.queries import QUERIES
from tabgrove.sources.shared import materialise

NATIVE = ("op5_rendezvous_sharding", "op7_scaled_sketch", "op8_source_mixing")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    actual = sorted(tuple(row[c] for c in columns) for row in result.collect())
    assert actual == sorted(tuple(r[i] for i in order) for r in expected.fetchall())


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(name, spark, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if x in plan]
    assert result.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {row[0] for row in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        now = {row[0] for row in out.select("doc_id").collect()}
        assert now and now <= ids
        if name == "near_duplicates":
            assert out.count() == len(now)
        if name == "secrets":
            assert now == ids
        docs, ids = out, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()


def test_mixture_takes_part_of_a_long_document(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [("a", " \n".join(words)), ("b", "x y z " * 20), ("c", "q " * 8000), ("c", None), ("b", " ")]
    rows = [(i, text, "en", source, len(text or "")) for i, (source, text) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixing.mix(docs, "doc_id", "text", "source")
    wanted = {row["source"]: row["target"] for row in mixed.targets.collect()}
    out = corpus_pipeline.mixture(spark, docs, "").collect()
    for source, target in wanted.items():
        assert abs(sum(len((r["text"] or "").split()) for r in out if r["source"] == source) - target) <= 0.5
    assert all((texts[r["doc_id"]][1] or "").startswith(r["text"] or "") for r in out)
    assert all(len(r["text"] or "") == r["n_chars"] for r in out)
    assert sorted(r["doc_id"] for r in out if r["doc_id"] > 2) == [3, 4]


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Repeated rows, one id for unlike texts, NULL ids and texts, near copies, clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " tail", "en", "a", 1), (3, "only this " * 9, "en", "b", 1),
        (3, base.upper(), "en", "b", 1), (None, "nothing like it " * 8, "en", None, 1), (None, base, "en", None, 1),
        (4, None, None, None, None), (4, None, None, None, None), (5, "", "en", "b", 0), (6, 'password = "q9w8e7r6t5y4"', "en", "b", 9),
    ]
    df = spark.createDataFrame(rows, ROWS)
    return df.withColumns({n: F.lit("x") for n in ("row", "key", "kept", "copies", "words", "is_part", "component_id")})


def test_near_duplicates_keep_one_row_of_each_group(spark, sf_dir):
    out = corpus_pipeline.near_duplicates(spark, odd_documents(spark), sf_dir)
    assert out.columns == corpus_pipeline.COLUMNS
    found = [(r["doc_id"], (r["text"] or "").lower()[:9]) for r in out.collect()]
    # The copies are one group, whose smallest id is NULL; texts without words are alone.
    assert sorted(found, key=str) == sorted(
        [(None, "w0 w1 w2 "), (3, "only this"), (None, "nothing l"), (4, ""), (4, ""), (5, ""), (6, "password ")], key=str
    )


def test_stages_keep_rows_of_shared_ids_apart(spark, tmp_path):
    docs = odd_documents(spark)
    spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.count() == round(3 / 5 * 11)  # three of the five labelled rows are good
    mixed = corpus_pipeline.mixture(spark, docs, "").collect()
    assert all(r["n_chars"] in (None, 0, 1, 9, len(r["text"] or "")) for r in mixed)
    assert sum(r["doc_id"] == 4 for r in mixed) == 2
    masked = corpus_pipeline.secret_scan(spark, docs, "").collect()
    assert len(masked) == 11 and not [r for r in masked if "q9w8e7r6t5y4" in (r["text"] or "")]
    encoded = corpus_pipeline.encoding(spark, docs, "").collect()
    assert [r["n_tokens"] for r in encoded if r["doc_id"] == 4] == [0, 0] and len(encoded) == 11


def test_stages_of_an_empty_table(spark, tmp_path):
    empty = odd_documents(spark).limit(0)
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    empty.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
