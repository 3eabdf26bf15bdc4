"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from tabgrove.llm import (
    alignment, bpe, chat, importance, jaccard, mixing, repeats, secrets, sharding, sketch, token_files, vector_codes,
    vectors,
)
from tabgrove.llm.common import in_arrow
from tabgrove.sources.shared import materialise

SHARDS = 24
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# An id that the rank file leaves free ends each document of a token file.
SEPARATOR = 50256


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark, sf_dir):
    """Every document with its log importance weight and whether it is in the sample."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return importance.resample(documents, labels, "doc_id", "text")


def op2_embedding_near_dedup(spark, sf_dir):
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def spans_text(spans):
    """Spans as kind:start:end, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def op3_secret_scan(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op4_byte_bpe(spark, sf_dir):
    """Encode, then decode what was encoded; digests of both."""
    ranks = bpe.read_ranks(RANKS)
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", ranks)
    decoded = bpe.decode_ids(encoded, "doc_id", "ids", ranks)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_rendezvous_sharding(spark, sf_dir):
    placed = sharding.assign_shards(
        table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1)
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_scaled_sketch(spark, sf_dir):
    """Likeness is the estimated containment; where sketches leave it open, that is a text
    without words, or one whose few hashes lie above the limit, only an equal text is like."""
    rows = sketch.spliced(table(spark, sf_dir, "documents"), "doc_id", "text")
    equal = lambda same: F.when(same, 1.0).otherwise(0.0)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("own")).alias("fingerprint"),
        sketch.fingerprint(F.col("edit")).alias("edited_fingerprint"),
        F.coalesce(
            sketch.containment(F.col("own"), F.col("edit")), equal(F.col("text") == F.col("edited"))
        ).alias("near_edited"),
        F.coalesce(
            sketch.containment(F.col("own"), F.col("next")), equal(F.col("same_next"))
        ).alias("near_next"),
    )


def op8_source_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.taken_words(mixed).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def with_template_in_text(spark, sf_dir):
    """All conversations and number -7, whose texts hold the template's control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    turns = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))))
    made = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(turns)).withColumn("text", text)
    return rows.unionByName(made.withColumn("turn", F.col("turn").cast("long")))


def op9_reply_trees(spark, sf_dir):
    messages = chat.linear_trees(with_template_in_text(spark, sf_dir))
    paths = chat.choose_paths(messages)
    formatted = chat.format_paths(paths, messages)

    def make(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {name: [] for name in names}
        for text, spans in zip(batch["formatted"].to_pylist(), batch["loss"].to_pylist()):
            turns = chat.parse(text)
            learnt = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in spans)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            made["n_turns"].append(len(turns))
            made["turns_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
            made["loss_chars"].append(len(learnt))
            made["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
            made["formatted_chars"].append(len(text))
        return {"conv_id": batch["tree"]} | made

    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_arrow(formatted, schema, make)


def op10_token_counts(spark, sf_dir):
    return token_files.documents_token_counts(
        table(spark, sf_dir, "documents"), "doc_id", "text", bpe.read_ranks(RANKS), SEPARATOR
    )


def op11_token_alignment(spark, sf_dir):
    files = alignment.Tokenizers(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    rows = alignment.align_texts(table(spark, sf_dir, "documents"), "doc_id", "text", files)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    rows = materialise(rows.withColumn("groups_sha256", digest).drop("groups"))
    counted = alignment.count_links(rows, alignment.pair_totals(rows, alignment.vocabulary_size(files)))
    return counted.withColumnRenamed("key", "doc_id")


def op12_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return vector_codes.label_errors(coded).select(
        F.col("key").alias("vec_id"),
        F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"),
    )


def op13_substring_dedup(spark, sf_dir):
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return left.select(
        F.col("key").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_importance_resampling,
        op2_embedding_near_dedup,
        op3_secret_scan,
        op4_byte_bpe,
        op5_rendezvous_sharding,
        op6_ngram_jaccard_join,
        op7_scaled_sketch,
        op8_source_mixing,
        op9_reply_trees,
        op10_token_counts,
        op11_token_alignment,
        op12_vector_codes,
        op13_substring_dedup,
    )
}
