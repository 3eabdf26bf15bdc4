"""Product codes of vectors, learnt and applied in exact integers.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook that a few rounds of assignment and averaging fit to every row. What a round has
to compute is kept small by flat blocks: the parts of one position lie along a Hilbert
curve, and each block of neighbours stores its bounding box, sums and count. From the
distances between box and entries follows which entries can be nearest to any row of the
block. If one entry is left, the block's sums answer for its rows; else exact integer
distances to the entries on the shortlist do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import _arrow_schema, joined
from tabgrove.sources.shared import materialise

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

# Rows in a block, and the bits of each coordinate's cell on the curve: layout only.
BLOCK = 256
CELL_BITS = 3

# Beyond this, squared distances might leave 64 bits; such vectors raise.
LARGEST = 1 << 24


def integer_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(row, key, label, v array<int>)`` of the usable rows, written once.

    Vectors that are NULL, empty or hold a NULL or non-finite component are dropped.
    """
    x = F.col("vector")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.where(usable).withColumn("row", F.monotonically_increasing_id())
    large = F.exists(x, lambda c: F.abs(c.cast("double")) * SCALE >= LARGEST)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    told = F.when(large, F.raise_error(F.lit(f"a component is {LARGEST // SCALE} or more"))).otherwise(whole)
    return materialise(rows.select("row", "key", "label", told.alias("v")))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Parts of the ``entries`` smallest keys; ties of keys go by their vectors."""
    order = [F.col("key").asc_nulls_last(), "v"]
    rows = np.array([r[0] for r in vectors.orderBy(*order).limit(entries).select("v").collect()], np.int64)
    return [np.ascontiguousarray(p) for p in np.split(rows, parts, axis=1)]


def _hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells, as big-endian bytes.

    Gray-code exchange of the axes, plane by plane, on all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = np.uint32(1 << b)
        low = np.uint32(q - 1)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(on, low, swap).astype(np.uint32)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & np.uint32(1 << b), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = [(x[i] >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.array(planes, np.uint8).T, axis=1)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def blocks(vectors: DataFrame, dimension: int, parts: int) -> DataFrame:
    """Flat blocks of each part position along a Hilbert curve, written once.

    One row for each block: ``part``, the rows' numbers and components (packed), the box
    ``low`` and ``high``, and ``sums``. Blocks are cut within ranges of (part, place,
    row), so that rows with one vector are no hot key.
    """
    width = dimension // parts
    ends = vectors.agg(*(
        f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dimension) for n, f in (("lo", F.min), ("hi", F.max))
    )).collect()[0]
    low = np.array([ends[f"lo{i}"] for i in range(dimension)], np.int64)
    span = np.array([ends[f"hi{i}"] for i in range(dimension)], np.int64) - low + 1
    placed = "part int, place binary, row long, v binary"
    schema = _arrow_schema(vectors, placed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, dimension).astype(np.int64)
            cells = ((v - low) << CELL_BITS) // span
            for part in range(parts):
                own = slice(part * width, (part + 1) * width)
                where = _hilbert(cells[:, own], CELL_BITS)
                flat = np.ascontiguousarray(v[:, own]).astype("<i4")
                yield pa.RecordBatch.from_arrays([
                    _column([part] * len(v), pa.int32()),
                    _column([p.tobytes() for p in where], pa.binary()),
                    batch.column(0),
                    _column([p.tobytes() for p in flat], pa.binary()),
                ], schema=schema)

    cut = "part int, rows binary, flat binary, low array<bigint>, high array<bigint>, sums array<bigint>"
    target = _arrow_schema(vectors, cut)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            rows = batch.column("row").to_numpy()
            flat = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, width)
            made: dict[str, list] = {f.name: [] for f in target}
            turns = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for begin, end in zip(turns[:-1], turns[1:]):
                for at in range(begin, end, BLOCK):
                    to = min(at + BLOCK, end)
                    v = flat[at:to].astype(np.int64)
                    made["part"].append(int(part[at]))
                    made["rows"].append(rows[at:to].astype("<i8").tobytes())
                    made["flat"].append(flat[at:to].tobytes())
                    made["low"].append(v.min(axis=0))
                    made["high"].append(v.max(axis=0))
                    made["sums"].append(v.sum(axis=0))
            if made["part"]:
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    dealt = vectors.select("row", "v").mapInArrow(place, placed)
    dealt = dealt.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    return materialise(dealt.mapInArrow(gather, cut))


def _shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Indexes of the entries that may be nearest to a vector within the box.

    An entry is out if its least distance to the box exceeds another's greatest.
    """
    under, over = low - book, book - high
    least = np.maximum(np.maximum(under, over), 0)
    most = np.maximum(np.abs(under), np.abs(over))
    return np.flatnonzero((least * least).sum(axis=1) <= (most * most).sum(axis=1).min())


def _nearest(flat: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index.

    Where every partial sum stays below 2**53 the products run in doubles, which are
    exact there; else in 64-bit integers.
    """
    top = max(int(np.abs(flat).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(flat.shape[1], 1) < 1 << 53 else np.int64
    v, b = flat.astype(kind), book.astype(kind)
    partial = (b * b).sum(axis=1) - 2 * (v @ b.T)
    best = partial.argmin(axis=1)
    return best, (partial[np.arange(len(v)), best] + (v * v).sum(axis=1)).astype(np.int64)


def _each_block(books: list[np.ndarray], sums_only: bool) -> Callable:
    """For each block: ``(part, rows, flat, shortlist, nearest, distance)``, the last two
    None where one entry is left and the sums are all that is asked for."""

    def answers(batch: pa.RecordBatch):
        columns = [batch.column(n) for n in ("part", "rows", "flat", "low", "high", "sums")]
        for part, rows, flat, low, high, sums in zip(*(c.to_pylist() for c in columns)):
            book = books[part]
            some = _shortlist(np.array(low, np.int64), np.array(high, np.int64), book)
            rows = np.frombuffer(rows, "<i8")
            if sums_only and len(some) == 1:
                yield part, rows, sums, int(some[0]), None, None
                continue
            v = np.frombuffer(flat, "<i4").reshape(len(rows), -1).astype(np.int64)
            near, distance = _nearest(v, book[some])
            yield part, rows, v, None, some[near], distance

    return answers


def _round(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the floored mean of its parts; unused entries stay.

    Each batch adds up its blocks; one row for each (task's batch, part, entry) is
    shuffled, one for each (part, entry) reaches the driver.
    """
    width = books[0].shape[1]
    schema = "part int, entry int, n long, sums array<bigint>"
    target = _arrow_schema(table, schema)
    answers = _each_block(books, True)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), width), np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for part, rows, v, only, near, _ in answers(batch):
                if near is None:
                    total[part][only] += v
                    count[part][only] += len(rows)
                else:
                    np.add.at(total[part], near, v)
                    np.add.at(count[part], near, 1)
        used = [(p, int(e)) for p in range(len(books)) for e in np.flatnonzero(count[p])]
        columns = [
            [p for p, _ in used], [e for _, e in used], [int(count[p][e]) for p, e in used], [total[p][e] for p, e in used]
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    added = table.mapInArrow(add, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))
    )
    books = [b.copy() for b in books]
    for row in added.collect():
        books[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return books


def compress(
    df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(key, label, codes array<int>, error)`` of every usable row, and the codebooks.

    Components become ``floor(1024 * x)``, which must stay below 2**24. Vectors that are
    NULL, empty, or hold NULL or non-finite components are dropped, as are those whose
    length differs from that of the smallest key. That length must be a multiple of
    ``parts``. Codebooks start with the parts of the ``entries`` smallest keys (NULL
    last, ties by vector; fewer rows give fewer entries). Equal distances go to the lower
    index. ``error`` is the squared distance between a vector and its code's entries.
    Repeated rows count and come out each. Columns of other names are ignored; a table
    without usable rows gives no rows and no codebooks.

    Only codebooks and one sum for each entry reach the driver, whatever the rows.
    """
    vectors = integer_vectors(df, key, vector, label)
    result = "row long, part int, entry int, distance long"
    first = vectors.orderBy(F.col("key").asc_nulls_last(), "v").limit(1).select(F.size("v")).collect()
    if not first:
        empty = vectors.select("key", "label", F.col("v").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty, []
    dimension = first[0][0]
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components do not make {parts} equal parts")
    vectors = vectors.where(F.size("v") == dimension)
    books = first_codebooks(vectors, parts, entries)
    table = blocks(vectors, dimension, parts)
    for _ in range(rounds):
        books = _round(table, books)
    target = _arrow_schema(table, result)
    answers = _each_block(books, False)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, _, _, near, distance in answers(batch):
                columns = [pa.array(rows), pa.array(np.full(len(rows), part)), pa.array(near), pa.array(distance)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    near = table.mapInArrow(assign, result).groupBy("row").agg(
        *(F.max(F.when(F.col("part") == p, F.col("entry"))).alias(f"c{p}") for p in range(parts)),
        F.sum("distance").alias("error"),
    )
    coded = vectors.select("row", "key", "label").join(near, "row")
    codes = F.array(*(f"c{p}" for p in range(parts)))
    return materialise(coded.select("key", "label", codes.alias("codes"), "error")), books


def label_errors(coded: DataFrame) -> DataFrame:
    """Rows of ``compress`` with ``label_error``, the errors of their label added up; rows
    without a label count together."""
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return joined(coded, total, ["label"])


def codebooks_digest(books: list[np.ndarray]) -> str:
    """Digest of all components in decimal, by part, entry and position."""
    told = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return hashlib.sha256(told.encode()).hexdigest()
