"""A corpus pipeline of five stages over the table of documents.

Each stage takes and returns documents (doc_id, text, lang, source, n_chars); the last
returns encoded documents. Stages decide row by row: rows that repeat another, or share
its doc_id, are documents of their own. NULL texts stay NULL up to the last stage, where
they have no tokens. Other columns are dropped, an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgrove.llm import bpe, importance, jaccard, mixing, secrets
from tabgrove.llm.common import identified, merged
from tabgrove.sources.shared import emptied, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with ``row``, by which a stage's decisions find their way back."""
    return identified(docs.select(*COLUMNS), "doc_id", "row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the importance sample drawn to look like the documents labelled good; a label
    holds for every row of its doc_id."""
    rows = numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    labels = labels.join(rows.select("doc_id", "row"), "doc_id").select("row", "quality")
    drawn = importance.resample(rows, labels, "row", "text").where("kept").select("row")
    return merged(rows, drawn, "row", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of smallest doc_id; of equal
    ones any."""
    rows = numbered(docs)
    found = jaccard.jaccard_components(rows, "row", "text")
    return merged(rows, found.where("row = component_id").select("row"), "row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows."""
    masked = secrets.redact_secrets(docs.select(*COLUMNS), "text")
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, and the first words of what it takes in
    part; documents without words stay once."""
    rows = numbered(docs)
    mixed = mixing.mix(rows, "row", "text", "source")
    taken = mixing.mixed_texts(rows, "row", "text", mixed)
    n_chars = F.when(F.col("is_part"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return taken.withColumn("n_chars", n_chars).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the byte at which each token begins; a NULL text
    has none."""
    encoded = bpe.encode_texts(docs, "doc_id", "text", bpe.read_ranks(RANKS))
    return encoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", "offsets")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixture", mixture),
    ("encoding", encoding),
]

# Hashed models, noise and merges cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again, so lineage stays short; what
    a stage has read is emptied once its own result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            emptied(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
