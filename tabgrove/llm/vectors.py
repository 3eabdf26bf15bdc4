"""Near-duplicate embeddings: rotated binary codes whose estimates decide what is computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import components, in_arrow, joined
from tabgrove.sources.shared import materialise

# Vectors a bucket aims at, and those of one side of a block comparison.
BUCKET, BLOCK = 1024, 4096
# The chance that a pair right at the threshold meets in no table, and the chance that its
# estimate falls below its confidence bound.
MISS, FAILURE = 1e-9, 1e-9
# Pairs looked at together.
PAIRS = 1 << 16
# Steps of a rotated vector's coordinates on either side of 0.
STEPS = 127


@lru_cache(maxsize=64)
def rotation(dim: int, number: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    normal = np.random.default_rng((seed, dim, number)).standard_normal((dim, dim))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=64)
def confidence(dim: int, failure: float) -> float:
    """How far one coordinate of a random unit vector of ``dim`` - 1 dimensions goes below 0
    with probability ``failure``: at most 1, about normal deviations / sqrt(dim - 1)."""
    if dim < 4:
        return 1.0
    # The coordinate's density is (1 - t^2)^((dim - 4) / 2); its tail is summed up from 1.
    t = np.linspace(1, 0, 200_001)
    log = (dim - 4) / 2 * np.log(np.maximum(1 - t * t, 1e-300))
    tail = np.cumsum(np.exp(log))
    return float(t[max(0, int(np.searchsorted(tail, 2 * failure * tail[-1])) - 1)])


def tables_for(n: int, dim: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a bucket's key, and how many tables, for ``n`` vectors of one label.

    A bit of two vectors at the threshold agrees with probability 1 - angle / pi. The
    tables are as many as make the chance to meet in none at most ``miss``; with 0 bits
    one table holds every pair.
    """
    bits = max(0, round(math.log2(max(n, 1) / BUCKET))) if dim > 1 else 0
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(miss) / math.log(1 - meet))


def bucket_bits(units: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The sign bits of rotated vectors that make the keys: rows x tables x bits."""
    n, dim = units.shape
    found = np.zeros((n, tables, bits), bool)
    per = max(1, dim // bits) if bits else tables
    for t in range(tables if bits else 0):
        for b in range(bits):
            place = (t % per) * bits + b
            axis = rotation(dim, 1 + t // per + place // dim * tables, seed)[place % dim]
            found[:, t, b] = units @ axis > 0
    return found


def bucket_keys(found: np.ndarray) -> np.ndarray:
    """The key of each vector in each table."""
    return found @ (1 << np.arange(found.shape[2], dtype=np.int64))


def encode(units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: its rotated coordinates in ``STEPS`` steps, the step, the sign code's
    correction factor, and the greatest error that the steps make.

    The code is the signs of the rotated vector, divided by sqrt(dim); the factor is its
    inner product with the vector. The steps let another code be compared without the
    vector: the error of that inner product is at most half a step in every coordinate.
    """
    dim = units.shape[1]
    turned = units @ rotation(dim, 0, seed).T
    step = np.abs(turned).max(axis=1) / STEPS
    steps = np.rint(turned / step[:, None]).astype(np.int8)
    # A coordinate that rounds to 0 keeps its sign by a whole step; the error then too.
    none = steps == 0
    steps[none] = np.where(turned[none] > 0, 1, -1)
    error = np.abs(steps * step[:, None] - turned).sum(axis=1) / math.sqrt(dim)
    return steps, step, np.abs(turned).sum(axis=1) / math.sqrt(dim), error


def inner_products(steps: np.ndarray, step: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of vectors, by their steps, with the codes of others."""
    return (steps * step[:, None]).astype(np.float32) @ _signs(codes).T


def _signs(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(codes.shape[1]))


def estimates(steps: np.ndarray, step: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of vectors with coded ones: the inner
    product with the code, divided by its factor."""
    return inner_products(steps, step, codes) / factors.astype(np.float32)[None, :]


def margins(factors: np.ndarray, dim: int, threshold: float, failure: float = FAILURE) -> np.ndarray:
    """How far below the threshold the estimate of a pair that reaches it may lie, by the
    factor of the code, the errors of the other's steps apart.

    The code is its factor times the coded vector plus a part across it, whose direction is
    uniform over random rotations. Of that part the other vector sees sqrt(1 - c^2), for
    a pair of cosine c, times one coordinate of a random direction: the estimate is off
    by more than this margin with probability ``failure``, less above the threshold.
    """
    across = np.sqrt(np.maximum(0, 1 - factors**2)) / factors
    return across * math.sqrt(1 - threshold**2) * confidence(dim, failure)


def least_products(factors: np.ndarray, dim: int, threshold: float, failure: float) -> np.ndarray:
    """The inner product with a code from which a pair may reach the threshold: where the
    estimate is the threshold less its margin and a little for rounding."""
    return ((threshold - margins(factors, dim, threshold, failure) - 1e-4) * factors).astype(np.float32)


def open_pairs(
    coded: tuple[np.ndarray, ...],
    keys: np.ndarray,
    table: int,
    left: np.ndarray,
    right: np.ndarray | None,
    threshold: float,
    failure: float,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, between ``left`` and ``right`` or within ``left``, whose estimate is
    within its margin of the threshold, errors of the steps in full, and that share no key
    before ``table``; some at a time."""
    steps, step, factors, errors = coded
    others = left if right is None else right
    signs, dim = _signs(steps[others]).T.copy(), steps.shape[1]
    least = least_products(factors[others], dim, threshold, failure)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        # Within one block only what comes after a row is a pair of its own.
        skip = at if right is None else 0
        near = (steps[rows] * step[rows][:, None]).astype(np.float32) @ signs[:, skip:]
        near += errors[rows].astype(np.float32)[:, None]
        i, j = np.nonzero(near >= least[skip:])
        if right is None:
            after = j > i
            i, j = i[after], j[after]
        i, j = rows[i], others[j + skip]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            first = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
            yield a[first], b[first]


def reached(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches over the pairs and those before, where
    ``root`` is what it reaches over those before."""
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def is_usable(embedding: Column, label: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(embedding, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & ~bad & ~zero, F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of the two blocks that a group compares; None for the second of one block."""
    own, low, high = table["own"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
    return np.flatnonzero(own == low), None if low == high else np.flatnonzero(own == high)


_CODED = (
    "node long, label string, dim int, n long, steps binary, step double, factor double, error double, "
    "bits binary, keys array<long>"
)
_CODE = ["n", "steps", "step", "factor", "error", "bits"]
_GROUP = ["label", "dim", "table", "bucket", "low", "high"]


def _coded(named: DataFrame, threshold: float, miss: float, seed: int) -> DataFrame:
    """Code and keys of each vector of ``(node, label, dim, e, n)``."""

    def make(batch: pa.RecordBatch) -> dict:
        table = batch.select(["dim", "n"]).to_pandas()
        made: dict[str, list] = {n: [None] * len(table) for n in ("steps", "step", "factor", "error", "bits", "keys")}
        for (dim, n), part in table.groupby(["dim", "n"]):
            at = part.index.to_numpy()
            units = _units(batch["e"].take(pa.array(at)))
            found = bucket_bits(units, *tables_for(n, dim, threshold, miss), seed)
            packed, keys = np.packbits(found.reshape(len(at), -1), axis=1), bucket_keys(found)
            steps, *numbers = encode(units, seed)
            for k, i in enumerate(at.tolist()):
                made["steps"][i], made["bits"][i], made["keys"][i] = steps[k].tobytes(), packed[k].tobytes(), keys[k]
                made["step"][i], made["factor"][i], made["error"][i] = (x[k] for x in numbers)
        made["keys"] = pa.array(made["keys"], pa.list_(pa.int64()))
        return {name: batch[name] for name in ("node", "label", "dim", "n")} | made

    return in_arrow(named, _CODED, make)


def _unpacked(
    table: pa.Table, threshold: float, miss: float
) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The codes of a group's rows, and their key in each table."""
    dim, size, rows = table["dim"][0].as_py(), table["n"][0].as_py(), table.num_rows
    bits, tables = tables_for(size, dim, threshold, miss)
    steps = np.frombuffer(b"".join(table["steps"].to_pylist()), np.int8).reshape(rows, dim)
    packed = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(rows, -1)
    found = np.unpackbits(packed, axis=1, count=tables * bits).reshape(rows, tables, bits)
    return (steps, *(table[c].to_numpy() for c in ("step", "factor", "error"))), bucket_keys(found)


def _placed(codes: DataFrame) -> DataFrame:
    """A row for each vector, table and group of its bucket; buckets above the block size
    are cut into blocks, and a pair of blocks is a group of its own."""
    met = codes.select("node", "label", "dim", F.posexplode("keys").alias("table", "bucket"))
    bucket = _GROUP[:4]
    filled = met.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1")
    placed = met.join(filled, bucket).withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(
        "node", *bucket, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )


def link_vectors(
    df: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    miss: float = MISS,
    failure: float = FAILURE,
    seed: int = 0,
) -> DataFrame:
    """``(key, n_links, component_id, kept)``: links at ``threshold`` between vectors of
    one label and one length, and the connected groups they make.

    Equal vectors are collapsed first, so copies cost one row. The others meet in hash
    tables of sign bits of random rotations, enough of them that a pair at the threshold
    is missed with probability ``miss`` at most. A bucket compares codes: the estimate of
    each inner product, from one vector's code and factor and the other's rounded
    coordinates, and its confidence bound tell which pairs may reach the threshold; one
    that does is passed over with probability ``failure`` at most. Vectors are fetched
    for the nodes of those pairs only, and the pairs' cosines computed in doubles. A pair
    counts in the first table in which it meets; groups send one row per vector, never
    pairs.

    Rows with a NULL label, or vectors that are NULL, empty, zero or hold NULL or
    non-finite components have no links and are their own component. Repeated keys keep
    their rows, NULL keys are greater than all others. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding).alias("e"))
    usable = is_usable(F.col("e"), F.col("label"))
    marks = ["label", "dim", "h1", "h2"]
    hashed = rows.where(usable).select(
        "*",
        F.size("e").alias("dim"),
        F.xxhash64("e").alias("h1"),
        F.xxhash64(F.lit(1), "e").alias("h2"),
    )
    distinct = hashed.groupBy(*marks).agg(
        F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e")
    )
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()))
    each = distinct.drop("e")
    sizes = each.groupBy("label", "dim").agg(F.count("*").alias("n"))
    named = distinct.join(sizes, ["label", "dim"]).where("n > 1")
    named = named.select("node", F.col("label").cast("string").alias("label"), "dim", "e", "n")
    codes = materialise(_coded(named, threshold, miss, seed))
    placed = _placed(codes).join(codes.select("node", *_CODE), "node")
    nominated_as = "node long, own int, label string, dim int, table int, bucket long, low int, high int"

    def nominate(table: pa.Table) -> pa.Table:
        """The nodes of a group that are in a pair whose estimate leaves it open."""
        table, some = table.combine_chunks(), np.zeros(table.num_rows, bool)
        if table.num_rows > 1:
            coded, keys = _unpacked(table, threshold, miss)
            for a, b in open_pairs(coded, keys, table["table"][0].as_py(), *_sides(table), threshold, failure):
                some[a] = some[b] = True
        return table.select(["node", "own", *_GROUP]).filter(pa.array(some))

    nominated = materialise(placed.groupBy(*_GROUP).applyInArrow(nominate, nominated_as))
    exact = nominated.join(codes.select("node", *_CODE), "node").join(distinct.select("node", "copies", "e"), "node")
    found_schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        """The links of a group's nodes, and the smallest node that each reaches there."""
        table = table.sort_by("node").combine_chunks()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        units = _units(table["e"].chunk(0))
        coded, keys = _unpacked(table, threshold, miss)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for a, b in open_pairs(coded, keys, table["table"][0].as_py(), *_sides(table), threshold, failure):
            near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            a, b = a[near], b[near]
            links += np.bincount(a, copies[b], len(node)).astype(np.int64)
            links += np.bincount(b, copies[a], len(node)).astype(np.int64)
            root = reached(root, a, b)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]}).cast(found_schema)

    found = materialise(exact.groupBy(*_GROUP).applyInArrow(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    lead = group.join(each.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lead"))
    group = group.join(lead, "component").select("node", "lead")
    known = each.join(links, "node", "left").join(group, "node", "left").select(
        *marks,
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("lead", "rep").alias("component_id"),
    )
    members = hashed.select("key", *marks)
    linked = joined(members, known, marks).select("key", "n_links", "component_id")
    lone = rows.where(~usable).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.unionByName(lone)
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.col("key").isNull())
    return out.select(F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", kept.alias("kept"))
