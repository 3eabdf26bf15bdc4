"""Sharding by weighted rendezvous hashing of a stable record key; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import ranked

# Hex digits of a draw.
DIGITS = 12


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (int, from 0) that wins the draw for ``key``.

    Each shard draws -ln(u) / weight, u from the md5 of seed, key and shard alone, which any
    engine can repeat, and the smallest draw wins, ties by number: a shard gets keys in proportion to its weight. A new shard can only win
    keys for itself, and one that leaves only loses its own. A shard of weight 0 gets
    nothing. Every NULL key goes to one shard, as every repeated key does.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be 0 or more, at least one above 0")
    shares = F.array(*(F.lit(float(w)) for w in weights))
    prefix = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"))

    def draw(shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(prefix, shard.cast("string"))), 1, DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 16.0**DIGITS
        weight = F.get(shares, shard)
        return F.struct(
            F.when(weight > 0, -F.log(u) / weight).otherwise(float("inf")).alias("draw"),
            shard.alias("shard"),
        )

    draws = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), draw)
    return F.array_min(draws)["shard"]


def assign_shards(
    df: DataFrame,
    key: str,
    text: str,
    weights: Sequence[float],
    grown_weights: Sequence[float] | None = None,
    seed: int = 0,
) -> DataFrame:
    """``(key, size, text_crc32, shard, slot, grown_shard)`` of every row.

    ``size`` is the text's UTF-8 bytes plus 8 (NULL text: none), ``text_crc32`` its
    unsigned checksum (NULL: that of the empty text), ``shard`` the winner of the draw,
    ``grown_shard`` the winner among ``grown_weights``, or NULL. ``slot`` is the row's
    gapless place in its shard, by key, checksum and size. Texts are never shuffled: the
    rows are reduced to five numbers before they are ranked.

    Repeated keys and repeated rows share a shard and get slots of their own. NULL keys
    are one key. Other columns are not read. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        rendezvous_shard(F.col(key), weights, seed).alias("shard"),
        (
            rendezvous_shard(F.col(key), grown_weights, seed)
            if grown_weights
            else F.lit(None).cast("int")
        ).alias("grown_shard"),
    )
    placed = ranked(narrow, ["key", "text_crc32", "size"], group=["shard"], name="slot")
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard"
    )
