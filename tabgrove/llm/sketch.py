"""Threshold-scaled sketches: every shingle hash below a fixed fraction; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import ranked
from tabgrove.sources.shared import materialise

WORDS = 5
# One hash in this many is retained, whatever the text's length; of a text with at most
# ``WHOLE`` different shingles every hash is.
SCALE, WHOLE = 4, 64
# Hex digits of a hash.
DIGITS = 8
SPACE = r"[\x20\x09-\x0D]+"


def sketch(text: Column, scale: int = SCALE, words: int = WORDS, whole: int = WHOLE) -> Column:
    """The sorted distinct hashes of a text's word shingles that lie below 1/scale, or all
    of them if there are at most ``whole``.

    A hash is 32 bits of the md5 of a shingle's words joined by spaces, so any engine can
    repeat it. A text with fewer words than a shingle is one shingle; NULL and a text
    without words have the empty sketch, and another text only by a chance of
    (1 - 1/scale) ** whole at most. Below the limit, sketches merge by union: that of
    several texts is the union of theirs.
    """
    limit = F.lit(f"{16**DIGITS // scale:0{DIGITS}x}") if scale > 1 else F.lit("g")

    def hashes(tokens: Column) -> Column:
        n = F.size(tokens)
        shingle = lambda i: F.array_join(F.slice(tokens, i + 1, words), " ")
        digits = lambda i: F.substring(F.md5(shingle(i)), 1, DIGITS)
        every = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), digits)
        return F.when(n > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    def kept(every: Column) -> Column:
        below_limit = F.filter(every, lambda h: h < limit)
        chosen = F.when(F.size(every) <= whole, every).otherwise(below_limit)
        return F.sort_array(F.transform(chosen, lambda h: F.conv(h, 16, 10).cast("long")))

    tokens = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    # One-element arrays bind words and hashes to a variable, so that they are made once.
    every = F.transform(F.array(tokens), hashes)
    return F.get(F.transform(every, kept), 0)


def fingerprint(hashes: Column) -> Column:
    """A sketch as text: its hashes, four bytes each, in order, in base 64."""
    digits = F.transform(hashes, lambda h: F.lpad(F.hex(h), DIGITS, "0"))
    return F.translate(F.base64(F.unhex(F.array_join(digits, ""))), "\r\n", "")


def below(hashes: Column, scale: int = SCALE) -> Column:
    """The hashes that a sketch holds whatever the text's length."""
    return F.filter(hashes, lambda h: h < F.lit(16**DIGITS // scale).cast("long"))


def merge(one: Column, other: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together, by the hashes below the limit."""
    return F.array_sort(F.array_union(below(one, scale), below(other, scale)))


def _comparable(one: Column, other: Column, scale: int) -> Column:
    """The hashes of ``one`` that ``other`` would hold too: all, if both hold hashes above
    the limit and so every one, else those below it."""
    limit = F.lit(16**DIGITS // scale).cast("long")
    return F.when((F.array_max(one) >= limit) & (F.array_max(other) >= limit), one).otherwise(below(one, scale))


def containment(of: Column, within: Column, scale: int = SCALE) -> Column:
    """The estimated share of a text's shingles that another has, by their sketches; NULL
    if nothing can be said: the first sketch has no hash that the second would hold.

    If both hold every hash the share is exact. Else the k hashes of the first that lie
    below the limit are a random sample of its shingles, and the standard deviation of a
    share c is sqrt(c * (1 - c) / k); k is about the number of shingles over ``scale``.
    """

    def share(hashes: Column) -> Column:
        found = F.size(F.array_intersect(hashes, within)).cast("double")
        return F.when(F.size(hashes) > 0, found / F.size(hashes))

    return F.get(F.transform(F.array(_comparable(of, within, scale)), share), 0)


def resemblance(one: Column, other: Column, scale: int = SCALE) -> Column:
    """The estimated Jaccard similarity, by the same hashes as ``containment``; NULL if
    there are none."""
    a, b = _comparable(one, other, scale), _comparable(other, one, scale)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)).cast("double") / union)


def following(df: DataFrame, key: str) -> DataFrame:
    """``(key, next)`` of each distinct key: the next larger one, after the last the first.

    NULL comes first. Only keys are moved, in ranges.
    """
    placed = materialise(ranked(df.select(key).distinct(), [key]))
    n = placed.count()
    shifted = placed.select(
        F.col(key).alias("next"),
        F.pmod(F.col("position") - 1, F.lit(max(n, 1))).alias("position"),
    )
    return placed.join(shifted, "position").select(key, "next")


def spliced(df: DataFrame, key: str, text: str, scale: int = SCALE) -> DataFrame:
    """Sketches of every text, of its edit, and of the text it was edited with.

    The edit replaces the last half of a text's code points (rounded down) by as many
    first ones of the next document by ascending key, or all of them. Returns key,
    n_chars, text, edited, ``same_next`` and the sketches ``own``, ``edit`` and ``next``.

    Each text is sketched once where it is scanned. By key are shuffled the texts with
    their sketches, and for the predecessor the sketch and as many code points as its
    edit takes. NULL texts are empty. NULL keys come first. Rows that repeat a key each
    give a row; the document that others are edited with is then the one of the key's
    greatest hash, and gives as many code points as the key's longest text takes. A single
    document follows itself, an empty table gives no rows. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    half = F.expr("length(text) div 2")
    keys = materialise(rows.groupBy("key").agg(F.count("*").alias("copies"), F.max(half).alias("takes")))
    after = following(keys, "key")
    links = keys.join(after.hint("merge"), keys.key.eqNullSafe(after.key))
    links = links.select(keys.key.alias("before"), "next", "takes")
    mark = F.xxhash64("text")
    sketched = rows.withColumn("own", sketch(F.col("text"), scale)).withColumn("mark", mark)
    givers = sketched
    if not keys.where("copies > 1").isEmpty():
        givers = sketched.groupBy("key").agg(F.max_by(F.struct("text", "own", "mark"), F.struct("mark", "text")).alias("g"))
        givers = givers.select("key", "g.*")
    gives = givers.join(links.hint("merge"), givers.key.eqNullSafe(links.next)).select(
        "before",
        F.substring("text", F.lit(1), F.col("takes")).alias("next_text"),
        F.col("own").alias("next"),
        F.struct(F.length("text"), "mark").alias("next_mark"),
    )
    both = sketched.join(gives.hint("merge"), sketched.key.eqNullSafe(gives.before))
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)
    )
    return both.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        "text",
        edited.alias("edited"),
        (F.struct(F.length("text"), "mark") == F.col("next_mark")).alias("same_next"),
        "own",
        "next",
    ).withColumn("edit", sketch(F.col("edited"), scale))
