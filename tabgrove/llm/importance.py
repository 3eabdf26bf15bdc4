"""Importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import in_arrow, mixed, ranked, run_hashes, slices, utf8
from tabgrove.sources.shared import materialise

# Buckets of hashed n-grams, the pseudo-count of each, and how many target texts are used.
BUCKETS, SMOOTHING, MAX_TARGET = 1 << 16, 1.0, 200_000

# Hex digits of a row's draw.
DIGITS = 12

# Classes of a byte: white space, punctuation, digit, lower case (and all of non-ASCII),
# upper case.
BLANK, MARK, DIGIT, LOW, HIGH = range(5)
_KIND = np.full(256, MARK, np.uint8)
_KIND[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = BLANK
_KIND[48:58] = DIGIT
_KIND[65:91] = HIGH
_KIND[97:123] = LOW
_KIND[128:] = LOW
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(flat: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram features of texts laid end to end: bucket, and number of the text.

    A text is a sequence of words and runs of punctuation. Its features are each token in
    lower case, and each pair and triple of neighbouring tokens' shapes: kind, case,
    punctuation as such, and whether the token repeats the one before.
    """
    kind = _KIND[flat]
    part = np.minimum(kind, DIGIT)  # words of letters and digits hold together
    change = np.ones(len(flat) + 1, bool)
    change[1:-1] = part[1:] != part[:-1]
    change[ends] = True
    at = np.flatnonzero(change)
    start, stop = at[:-1], at[1:]
    solid = part[start] != BLANK if len(start) else np.zeros(0, bool)
    word = run_hashes(_FOLD[flat], start)[0, solid]
    start, stop = start[solid], stop[solid]
    text = np.searchsorted(ends, start, side="right") - 1

    lows = np.concatenate([[0], np.cumsum(kind == LOW)])
    highs = np.concatenate([[0], np.cumsum(kind == HIGH)])
    low, high = lows[stop] - lows[start], highs[stop] - highs[start]
    first = kind[start] if len(start) else np.zeros(0, np.uint8)
    shape = np.where(
        first == MARK,
        word,
        np.where(
            low + high == 0, 1, np.where(high == 0, 2, np.where(low > 0, 3, np.where(stop - start > 1, 4, 3)))
        ).astype(np.uint64),
    )
    again = np.zeros(len(word), np.uint64)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shape = mixed(shape * np.uint64(2) + again)
    pair = (text[1:] == text[:-1]).nonzero()[0]
    pairs = mixed(shape[pair] * np.uint64(3) + shape[pair + 1])
    three = (text[2:] == text[:-2]).nonzero()[0]
    triples = mixed(mixed(shape[three] * np.uint64(5) + shape[three + 1]) + shape[three + 2])
    grams = np.concatenate([word, pairs, triples])
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[pair], text[three]])


def ngram_counts(df: DataFrame, key: str, text: str, targets: np.ndarray, buckets: int) -> DataFrame:
    """``(bucket, raw, target)``: n-gram counts over all texts and over those whose key is
    in ``targets`` (sorted). A task sums up before it sends, so what it sends is bounded."""

    def count(batches):
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for batch in batches:
            for some in slices(batch):
                grams, of = features(*utf8(some["text"]), buckets)
                raw += np.bincount(grams, minlength=buckets)
                keys = some["key"].fill_null(0).to_numpy()
                chosen = np.isin(keys, targets) & some["key"].is_valid().to_numpy(zero_copy_only=False)
                target += np.bincount(grams[chosen[of]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"]
        )

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "bucket long, raw double, target double")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw of every bucket: what the driver holds is one number each."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets)
    # The raw model smooths the target's: a gram that neither is known to favour weighs 0.
    share = raw + smoothing
    share /= share.sum()
    strength = smoothing * np.sqrt(buckets)
    return np.log((target + strength * share) / (target.sum() + strength)) - np.log(share)


def log_weights(df: DataFrame, key: str, text: str, ratios: np.ndarray) -> DataFrame:
    """``(key, log_weight)``: the summed log ratios of each text's n-grams, 0 without any."""
    buckets = len(ratios)

    def make(batch: pa.RecordBatch) -> dict:
        grams, of = features(*utf8(batch["text"]), buckets)
        return {
            "key": batch["key"],
            "log_weight": np.bincount(of, ratios[grams], minlength=batch.num_rows),
        }

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {df.schema[key].dataType.simpleString()}, log_weight double"
    return in_arrow(rows, schema, make)


def bounded_targets(labels: DataFrame, key: str, quality: str, bound: int) -> tuple[np.ndarray, float]:
    """At most about ``bound`` keys of good rows, those of smallest hash, and the share of
    good rows among all labelled ones. Rows without key or label don't count."""
    known = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull())
    n, good = known.agg(F.count("*"), F.count_if(F.col(quality) == 1)).collect()[0]
    rows = known.where(F.col(quality) == 1).select(F.col(key).cast("long").alias("key"))
    if good > bound:
        limit = -(2**63) + int(2**64 * bound / good)
        rows = rows.where(F.xxhash64("key") < F.lit(limit))
    keys = np.sort(np.array([row[0] for row in rows.distinct().collect()], np.int64))
    return keys, good / n if n else 1.0


def resample(
    df: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    quality: str = "quality",
    keep: float | None = None,
    seed: int = 0,
    buckets: int = BUCKETS,
    max_target: int = MAX_TARGET,
) -> DataFrame:
    """``(key, log_weight, rank, kept)``: documents drawn like the good ones.

    Two hashed n-gram models are counted: one over all texts, one over the good labelled
    ones (at most about ``max_target``, by hash). A text's weight is the ratio of its
    probabilities under the two; the k rows with the largest log weight plus Gumbel noise
    are a sample without replacement in proportion to the weights. k is ``keep`` times
    all rows, by default the good share of the labels, so that a clean table's rows stay.
    The noise comes from the md5 of seed and key, so reruns agree.

    NULL and empty texts have log weight 0. Repeated keys, and NULL keys among themselves,
    draw the same noise and are told apart by their weight, then by their place. Without
    labels every row is kept, of an empty table none; other columns are not read. The k
    largest are found by ranges; no range or row set is collected.
    """
    targets, share = bounded_targets(labels, key, quality, max_target)
    ratios = log_ratios(ngram_counts(df, key, text, targets, buckets), buckets)
    scored = materialise(log_weights(df, key, text, ratios))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(drawn, 1, DIGITS), 16, 10).cast("double") + 0.5) / 16.0**DIGITS
    placed = ranked(scored.withColumn("cost", -(F.col("log_weight") - F.log(-F.log(u)))), ["cost", "key"], name="rank")
    k = round((share if keep is None else keep) * scored.count())
    return placed.select(F.col("key").alias(key), "log_weight", "rank", (F.col("rank") < k).alias("kept"))
