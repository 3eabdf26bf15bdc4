"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgrove.llm.common import joined, ranked
from tabgrove.sources.shared import materialise

# Schedule points are fractions of 2**BITS; the step is one over the golden ratio, odd.
BITS = 60
GOLDEN = (isqrt(5 << 2 * BITS) - (1 << BITS)) // 2 | 1
SPACE = r"[\x20\x09-\x0D]+"
# Sources are rows of a table that the driver broadcasts; more than this many raise.
MAX_SOURCES = 100_000
# Slots are numbered within runs of this length, so that no source is one group.
RUN = 1 << 11


def word_count(text: Column) -> Column:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    return F.size(words).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(source, place, weight, source_size, target)`` of each source of ``(source, size)``.

    Sources by code point, NULL last, get the weights in turn. The targets share
    ``share`` times all sizes by weight; none goes above ``most`` times its source's
    size, and what it cannot take is shared by weight among the others until none is.
    """
    totals = materialise(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(named) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))))
    limit = F.col("source_size") * F.lit(float(most))
    rows = totals.select("source", "source_size", place.alias("place"), weight.alias("weight"))
    # By the level at which a source is full, all before the first that isn't are full.
    by_level = Window.orderBy(limit / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("full", limit <= F.col("level") * F.col("weight"))
    # The level falls after the first source that isn't full, which therefore has the greatest.
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), limit).otherwise(final * F.col("weight"))
    return rows.select("source", "place", "weight", "source_size", target.alias("target"))


@dataclass(frozen=True)
class Mix:
    """A mix as DataFrames.

    ``targets``: see ``source_targets``. ``schedule``: (slot, source, block), the order in
    which blocks of ``block_words`` words are taken. ``pieces``: (source, block, key, seq,
    epoch, first_word, words), what each block holds; the words of a source, in a
    shuffled order of its documents, are laid end to end and repeated. ``documents``:
    the rows of the table with ``seq``, their number.
    """

    targets: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    documents: DataFrame
    block_words: int


def mix(
    df: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int | None = None,
    seed: int = 0,
) -> Mix:
    """Mix documents so that each source's words come near its target.

    Slot j stands at the fractional part of j / golden ratio; the cumulative blocks of the
    targets map it to a source, and the slot's rank within the source is the block that it
    takes. A source thus gets its share of every run of slots, to within a few blocks, and
    over all slots exactly its target, to the nearest word: slots above its blocks go to
    the sources that have too few, and its last block is cut. No source is taken more than
    ``most`` times.

    ``block_words`` defaults to 1/256 of the smallest target, at least 1/2**24 of all and
    at most 2048; it sets how finely sources alternate, not how much of them is taken.
    Sizes are words; NULL texts have none and are never taken. A NULL
    source is one of its own. Repeated keys and rows are documents of their own. Equal
    input gives an equal mix. An empty table gives an empty mix. Texts aren't shuffled.
    """
    narrow = materialise(
        df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
        .withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    )
    targets = materialise(source_targets(narrow.select("source", "size"), weights, share, most))
    total, smallest = targets.agg(F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).collect()[0]
    total, smallest = total or 0.0, smallest or 0.0
    block = block_words or int(min(2048, max(1, smallest // 256, total // 2**24)))

    documents = materialise(laid_out(narrow))
    wanted = in_blocks(targets, block, most)
    schedule = materialise(scheduled(wanted))
    pieces = cut(documents, wanted, block)
    return Mix(targets, schedule, pieces, documents, block)


def laid_out(narrow: DataFrame) -> DataFrame:
    """Documents in shuffled order with ``begin``, the word of their source they begin at.

    The order is that of a hash of the key. Ranges of it sum up their sizes by
    themselves, and each adds the totals of those before.
    """
    placed = ranked(narrow, ["source", "draw", "key", "size"], name="seq")
    # Blocks of the order, at most as large as a run of slots; a source may have many.
    placed = placed.withColumn("run", F.expr(f"seq div {RUN}"))
    each = ["source", "run"]
    sums = placed.groupBy(*each).agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*each, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    placed = joined(placed, sums, each)
    own = Window.partitionBy(*each).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0))
    return placed.select("key", "source", "size", "seq", begin.cast("long").alias("begin"))


def in_blocks(targets: DataFrame, block: int, most: float) -> DataFrame:
    """``(source, place, source_size, words, blocks)``: the whole words of each target and
    the blocks that hold them."""
    limit = F.floor(F.col("source_size") * F.lit(float(most)))
    words = F.least(F.round("target"), limit).cast("long")
    return targets.select("source", "place", "source_size", words.alias("words")).withColumn(
        "blocks", F.expr(f"(words + {block - 1}) div {block}")
    )


def point(slot: Column) -> Column:
    """``slot * GOLDEN`` modulo ``2**BITS``, in halves of both so that nothing overflows."""
    half = BITS // 2
    low = lambda x: x.bitwiseAND(F.lit(2**half - 1))
    lower, upper = low(slot), F.shiftright(slot, half)
    first, second = F.lit(GOLDEN % 2**half), F.lit(GOLDEN >> half)
    carried = low(low(lower * second) + low(upper * first))
    return (lower * first + carried * F.lit(2**half)).bitwiseAND(F.lit(2**BITS - 1))


def scheduled(wanted: DataFrame) -> DataFrame:
    """``(slot, source, block)``: every slot's source by its point, ranked in its source.

    Points hit a source a few times more or less often than it has blocks. Slots above
    them are dealt, in order, to the blocks that were not hit, in the order in which
    these are due. There are a few of them for each source at most.
    """
    spark = wanted.sparkSession
    wanted = wanted.where("blocks > 0")
    slots = wanted.agg(F.sum("blocks")).collect()[0][0] or 0
    upto = Window.orderBy("place")
    edge = (F.sum("blocks").over(upto) / F.lit(float(max(slots, 1))) * 2.0**BITS).cast("long")
    bounds = wanted.select("source", edge.alias("high"), "place", "blocks")
    bounds = bounds.withColumn("low", F.lag("high", 1, 0).over(upto))
    last = F.max("place").over(Window.partitionBy())
    bounds = bounds.withColumn("high", F.when(F.col("place") == last, 2**BITS).otherwise(F.col("high")))
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point(F.col("slot")))
    # A grid of 2**10 cells turns the search for the interval into an equality; a cell has
    # as many rows as intervals that touch it, and the table is bounded by MAX_SOURCES.
    shift = BITS - 10
    cells = bounds.where("high > low").withColumn(
        "cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift)))
    )
    points = points.withColumn("cell", F.shiftright("point", shift))
    found = points.join(F.broadcast(cells), "cell").where("point >= low AND point < high")
    found = found.select("slot", "source", "place", "blocks", F.expr(f"slot div {RUN}").alias("run"))
    counts = found.groupBy("place", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    hit = materialise(
        found.withColumn("own", own).join(counts, ["place", "run"]).select(
            "slot", "source", "place", "blocks", (F.col("own") + F.col("base")).cast("long").alias("block")
        )
    )
    free = hit.where("block >= blocks").select("slot", F.row_number().over(Window.orderBy("slot")).alias("turn"))
    hits = hit.groupBy("place").agg(F.count("*").alias("hits"))
    missed = wanted.join(F.broadcast(hits), "place", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    missed = missed.where("hits < blocks").withColumn("block", F.explode(F.expr("sequence(hits, blocks - 1)")))
    due = Window.orderBy((F.col("block") + 0.5) / F.col("blocks"), "place")
    missed = missed.select("source", "block", F.row_number().over(due).alias("turn"))
    filled = free.join(missed, "turn").select("slot", "source", "block")
    return hit.where("block < blocks").select("slot", "source", "block").unionByName(filled)


def cut(documents: DataFrame, wanted: DataFrame, block: int) -> DataFrame:
    """What each block holds: the pieces of documents in it, over all times round a source.

    Only the words that the source's target takes are in them.
    """
    size = F.greatest("source_size", F.lit(1))
    per_source = wanted.select(
        "source",
        "source_size",
        F.col("words").alias("end"),
        F.ceil(F.col("words") / size).cast("int").alias("rounds"),
    )
    per_source = F.broadcast(per_source.where("rounds > 0"))
    rows = joined(documents, per_source, ["source"]).where("size > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    start = F.col("begin") + F.col("epoch") * F.col("source_size")
    rows = rows.withColumn("start", start).withColumn("stop", F.least(start + F.col("size"), F.col("end")))
    rows = rows.where("stop > start").withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}")))
    )
    first = F.greatest("start", F.col("block") * block)
    words = F.least("stop", (F.col("block") + 1) * block) - first
    return rows.select(
        "source",
        F.col("block").cast("long").alias("block"),
        "key",
        "seq",
        "epoch",
        (first - F.col("start")).alias("first_word"),
        words.alias("words"),
    )


def taken_words(mixed: Mix) -> DataFrame:
    """``(key, seq, size, source_size, target, taken)`` of each document: the words of its
    pieces in blocks that the schedule takes."""
    pieces, schedule = mixed.pieces, mixed.schedule
    taken = (
        joined(pieces, schedule, ["source", "block"])
        .groupBy("seq")
        .agg(F.sum("words").alias("taken"))
    )
    rows = mixed.documents.join(taken, "seq", "left")
    rows = joined(rows, F.broadcast(mixed.targets), ["source"])
    return rows.select(
        "key", "seq", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_texts(df: DataFrame, key: str, text: str, mixed: Mix) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, and ``is_part``: whether a row
    holds only the first words of its text.

    Only the document at which a source's words end is taken in part; its text is cut
    behind a word, spaces between the words stay. Rows that repeat a key share what is
    taken of them by their words. Documents without words have no part in the mix and
    stay once. Columns of ``df`` keep their names and order, whatever these are.
    """
    names = [f"_{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    key, text = (names[df.columns.index(c)] for c in (key, text))
    taken = taken_words(mixed).groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    whole = F.when(F.col("size") > 0, F.expr("taken div greatest(size, 1)")).otherwise(1)
    times = taken.select(F.col("key").alias(key), "taken", "size", whole.cast("int").alias("whole"))
    times = times.withColumn("left", F.col("taken") - F.col("whole") * F.col("size"))
    times = times.withColumn("copies", F.col("whole") + F.when(F.col("left") > 0, 1).otherwise(0))
    rows = joined(rows, times.where("copies > 0"), [key])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    part = F.col("copy") > F.col("whole")
    share = F.col("left") / F.greatest("size", F.lit(1)) * word_count(F.col(text))
    rows = rows.withColumn("words", F.when(part, F.round(share).cast("int")))
    rows = rows.where("words IS NULL OR words > 0")
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(ends, F.lit(1), F.col("words")), "")
    rows = rows.withColumn(text, F.when(part, first).otherwise(F.col(text)))
    return rows.select(*names, part.alias("is_part")).toDF(*df.columns, "is_part")
