"""What several operators share: distributed ranks, connected components, hashing words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabgrove.sources.shared import emptied, materialise, written

# Spark's monotonically_increasing_id: the partition above these bits, the row below.
ROW_BITS = 33

# White space between words: fixed values, as bytes of UTF-8.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def joined(
    left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equality of the named columns, NULL equal to NULL; they come out once."""
    marked = right.withColumnsRenamed({n: f"_{n}_" for n in names})
    on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_{n}_")) for n in names))
    return left.join(marked, on, how).drop(*(f"_{n}_" for n in names))


def ranked(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the gapless position, from 0, of each row within its group by ascending ``order``.

    No group is ever gathered in a task: rows are dealt into ranges of (group, order),
    each range numbers its own rows, and the counts of the ranges before it (a row for
    each range and group in it) are added. Rows that agree in every key are split by
    their place in the input, so repeated rows may spread over ranges too. The rows are
    written twice in the shared folder, so that both passes see the same ranges.
    """
    keys = [*group, *order]
    frozen = materialise(df.withColumn("_tie", F.monotonically_increasing_id()))
    dealt = frozen.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    dealt = materialise(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", ROW_BITS))
    each = [*group, "_range"]
    ranges = dealt.groupBy(*each).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    position = F.col("_at") - F.col("_first") + F.col("_before")
    out = joined(dealt, ranges, each)
    return out.select(*df.columns, position.cast("long").alias(name))


def identified(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``, a number that no two rows share and that ascends with ``key``.

    Keys that are unique and not NULL, as one narrow count tells, are their own numbers;
    else the rows are ranked by key, NULL first, and written in that order.
    """
    n, distinct = df.agg(F.count("*"), F.count_distinct(key)).collect()[0]
    return df.withColumn(name, F.col(key).cast("long")) if n == distinct else ranked(df, [key], name=name)


def merged(left: DataFrame, right: DataFrame, names: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join tables that both grow with the corpus: by a merge at every size, so that the
    driver builds no broadcast of what happens to be small."""
    return left.join(right.hint("merge"), names, how)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``: its smallest reachable node.

    Alternates large and small stars until the edges stop changing. Each round is two
    grouped minima and two joins over edges written in the shared folder, which are
    counted as they are written; neither edges nor components reach the driver, and the
    round before is emptied. Self-loops, NULL ends and repeats are ignored.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    spark = edges.sparkSession
    now, path, mark = _marked(pairs.distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = merged(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = merged(large, least, "a")
        small = near.select("a", F.col("m").alias("b")).unionByName(
            near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        before, old = mark, path
        now, path, mark = _marked(small.distinct())
        emptied(spark, old)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _marked(edges: DataFrame) -> tuple[DataFrame, str, tuple[int, int]]:
    """The edges as a written table, its place, and their number and a hash of them all."""
    seen = Observation()
    hashed = F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
    table, path = written(edges.observe(seen, F.count("*").alias("n"), hashed.alias("mark")))
    return table, path, (seen.get["n"], seen.get["mark"])


def slices(batch: pa.RecordBatch, rows: int = 2000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and about ``size`` bytes, so that what a
    task holds for one slice does not grow with the batch."""
    per = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, per):
        yield batch.slice(start, per)


def in_arrow(
    df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict | None], rows: int = 2000
) -> DataFrame:
    """``mapInArrow`` with ``make`` over small slices of the batches.

    ``make`` returns the columns of ``schema`` by name, or None for no rows.
    """
    target = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, rows):
                made = make(some)
                if made is not None:
                    arrays = [
                        x if isinstance(x, pa.Array) else pa.array(x, field.type, from_pandas=False)
                        for field in target
                        for x in (made[field.name],)
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end and the offsets of its rows; NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


# Masks of the first 0 to 8 bytes of a little-endian word; runs up to LANES bytes are hashed
# eight bytes at a time.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LANES = 64


def run_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two unrelated 64-bit hashes, two rows, of each run of bytes from one start to the
    next; the last one ends with ``data``.

    A run's length and then its bytes, eight at a time, are mixed in one after the other;
    each step maps one to one, so no two runs of one length up to 8 bytes are equal, and
    no pattern of letters cancels out. Longer runs than ``LANES`` take a 128-bit hash.
    """
    size = np.diff(np.append(starts, len(data))).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    first, length = view[starts] & _MASKS[np.minimum(size, 8)], size.astype(np.uint64)
    out = np.stack([mixed(first + mixed(length + np.uint64(0x51))), mixed(first ^ mixed(length + np.uint64(0xA7A7)))])
    longer = np.flatnonzero(size > 8)
    for at in range(8, LANES, 8):
        lane = view[starts[longer] + at] & _MASKS[np.minimum(size[longer] - at, 8)]
        out[0, longer] = mixed(out[0, longer] * np.uint64(3) + lane)
        out[1, longer] = mixed(out[1, longer] * np.uint64(5) + lane)
        longer = longer[size[longer] > at + 8]
    for i in longer.tolist():
        digest = xxhash.xxh3_128_digest(data[starts[i] : starts[i] + size[i]].tobytes())
        out[:, i] = np.frombuffer(digest, "<u8")
    return out


def chained(words: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of ``size`` words from ``head`` on, from the words' hashes: one
    word after the other is mixed in, so order and number count."""
    h = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(int(size.max(initial=0))):
        on = size > k
        if on.all():
            h = mixed(h * np.uint64(3) + words[head + k])
        else:
            h[on] = mixed(h[on] * np.uint64(3) + words[head[on] + k])
    return h


def summed(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of words ``first[i]:first[i + 1]``, of any length: the sum of the
    words' hashes, each mixed with its place."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    each = mixed(words + mixed(place.astype(np.uint64) + np.uint64(1)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    return mixed((sums[first[1:]] - sums[first[:-1]]) ^ mixed(np.diff(first).astype(np.uint64)))


def mixed(h: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit integers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def squeezed(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case A-Z and lay the words out with one space after each, document by document.

    Returns the bytes, each word's start and end in them, and the number of words before
    each document (one more entry than documents).
    """
    space = _SPACE[flat]
    after = np.concatenate([np.ones(1, bool), space])
    after[ends] = True
    begins = ~space & after[:-1]
    begins_at = np.flatnonzero(begins)
    word = np.cumsum(begins) - 1
    kept = np.flatnonzero(~space)
    place = np.arange(len(kept)) + word[kept]
    out = np.full(len(kept) + len(begins_at), 0x20, np.uint8)
    out[place] = _LOWER[flat[kept]]
    first = np.searchsorted(kept, begins_at)
    start = place[first] if len(first) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(kept)][: len(first)] - 1
    end = place[last] + 1 if len(first) else np.zeros(0, np.int64)
    return out, start, end, np.searchsorted(begins_at, ends)
