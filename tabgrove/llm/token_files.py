"""Token counts of flat, unindexed token files: separators found blockwise, stitched by a scan."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tabgrove.llm.bpe import encoder
from tabgrove.llm.common import slices
from tabgrove.sources.shared import materialise, settings, shared_folder

# Tokens of a block.
BLOCK = 1 << 18
# Blocks that are read one after the other, and bytes of a task, about.
TOGETHER, TASK = 64, 1 << 25


def write_token_files(
    df: DataFrame, text: str, rank_file: bytes, separator: int, path: str, key: str | None = None
) -> None:
    """Encode every text and write flat files of 16-bit little-endian ids under
    ``path/kind=tokens``, a separator after each document, one file for each input split;
    nothing else is in them.

    Spark's text writer puts the bytes out as they are and the separator's two bytes as
    the line end, so any filesystem and its commit protocol serve. NULL texts are empty.

    With ``key`` the same tasks also write ``path/kind=keys``: the number of each document
    in its file, and its key. A task writes both files as rows come, so that they agree
    whatever the splits of any other scan are. See ``read_keys``.
    """
    if not 0 <= separator < 1 << 16:
        raise ValueError("ids have 16 bits")

    def make(batch: pa.RecordBatch, before: int) -> Iterator[pa.RecordBatch]:
        ids, starts = encoder(rank_file).encode([x or "" for x in batch["text"].to_pylist()])
        if len(ids) and (ids.max() >= 1 << 16 or (ids == separator).any()):
            raise ValueError("an id needs more than 16 bits or is the separator")
        data = ids.astype("<u2").tobytes()
        cuts = (starts * 2).tolist()
        yield rows("tokens", [data[a:b] for a, b in zip(cuts, cuts[1:])])
        if key is not None:
            told = (k.encode().hex() if k is not None else "-" for k in batch["key"].to_pylist())
            yield rows("keys", [f"{before + i} {k}".encode() for i, k in enumerate(told)])

    def rows(kind: str, values: list[bytes]) -> pa.RecordBatch:
        arrays = [pa.array(values, pa.binary()), pa.array([kind] * len(values), pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["value", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for some in slices(batch, 500):
                yield from make(some, before)
                before += some.num_rows

    named = F.col(key).cast("string") if key is not None else F.lit(None).cast("string")
    encoded = df.select(F.col(text).alias("text"), named.alias("key")).mapInArrow(run, "value binary, kind string")
    lines = encoded.select(F.col("value").cast("string").alias("value"), "kind")
    # Both kinds are open at once: rows are written as they come, without a sort.
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": 8}):
        lines.write.partitionBy("kind").options(**_line_end(separator)).text(path)


def _line_end(separator: int) -> dict[str, str]:
    return {"lineSep": separator.to_bytes(2, "little").decode("latin-1"), "encoding": "ISO-8859-1"}


def read_keys(spark: SparkSession, path: str, separator: int, kind: DataType) -> DataFrame:
    """``(part, document, key)`` of the documents that ``write_token_files`` wrote: the
    number of the file, the document's number in it, and its key."""
    lines = spark.read.options(**_line_end(separator)).text(f"{path}/kind=keys")
    told = F.split("value", " ")
    key = F.when(told[1] != "-", F.unhex(told[1]).cast("string")).cast(kind)
    return lines.select(_part("_metadata.file_name"), told[0].cast("long").alias("document"), key.alias("key"))


def _part(file: str) -> Column:
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long").alias("part")


def opened(path: str) -> pa.NativeFile:
    """A file of Spark's listing, for reads at any place."""
    scheme, rest = re.fullmatch(r"(?:(\w[\w+.-]*):)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    found, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/@:')}")
    return found.open_input_file(inner)


def _opens(path: str) -> bool:
    try:
        opened(path).close()
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return False
    return True


def scan_blocks(spark: SparkSession, path: str, separator: int, block: int = BLOCK) -> DataFrame:
    """``(file, block, tokens, ends)``: each block's size and the places of separators in it.

    A file is cut into blocks of ``block`` tokens; each is compared with the separator as
    one array, aligned to whole ids. A file of odd length raises. The files are only
    listed; runs of blocks are dealt out, so a file of any size is read by many tasks,
    one block at a time. In a store that Arrow cannot open, Spark reads every file whole,
    which it refuses above 2 GiB.
    """
    wanted, run = np.uint16(separator), block * TOGETHER * 2
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    total, some = files.agg(F.sum("length"), F.min("path")).collect()[0]
    if some is None or _opens(some):
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(run).cast("long")))
        parts = files.select("path", "length", starts.alias("start"), F.lit(None).cast("binary").alias("content"))
        parts = parts.repartition(-(-(total or 1) // TASK))
    else:
        parts = files.select("path", "length", F.lit(0).cast("long").alias("start"), "content")

    def blocks(path_: str, start: int, stop: int, content: pa.Scalar) -> Iterator[pa.RecordBatch]:
        whole = content.as_buffer()
        with opened(path_) if whole is None else pa.BufferReader(whole) as file:
            for at in range(start, stop, 2 * block):
                size = min(2 * block, stop - at)
                data = file.read_at(size, at)
                if len(data) != size:
                    raise ValueError(f"{path_} ends early")
                ends = np.flatnonzero(np.frombuffer(data, "<u2") == wanted)
                arrays = [
                    pa.array([path_]),
                    pa.array([at // (2 * block)], pa.int64()),
                    pa.array([size // 2], pa.int64()),
                    pa.array([ends], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "tokens", "ends"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["path", "length", "start"]).to_pylist()
            for row, content in zip(rows, batch["content"]):
                if row["length"] % 2:
                    raise ValueError(f"{row['path']} does not hold whole ids")
                stop = row["length"] if content.is_valid else min(row["length"], row["start"] + run)
                yield from blocks(row["path"], row["start"], stop, content)

    return parts.mapInArrow(scan, "file string, block long, tokens long, ends array<long>")


def count_tokens(spark: SparkSession, path: str, separator: int, block: int = BLOCK) -> DataFrame:
    """``(file, document, n_tokens)``: the tokens of each document, in the files' order.

    A block only knows its own separators. Running sums over a file's blocks, one row of
    numbers a block, give the documents before each, and a running maximum the last
    separator before it; the block's documents then begin where the one before ended.
    The separators stay where they are written.
    Tokens after the last separator are a document too; empty documents count 0; a file
    without tokens has none.
    """
    scanned = materialise(scan_blocks(spark, path, separator, block))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("ends").cast("long")
    blocks = scanned.withColumn("begin", F.col("block") * block)
    last = F.when(n > 0, F.col("begin") + F.element_at("ends", -1))
    blocks = blocks.select("file", "block", "tokens", "begin", n.alias("n"), last.alias("last"))
    blocks = (
        blocks.withColumn("documents", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)))
        .withColumn("final", F.lead("block").over(order).isNull())
    )
    blocks = scanned.select("file", "block", "ends").join(blocks, ["file", "block"])
    # Separators of the file's own numbering, the one before the block first.
    ends = F.concat(
        F.array("open"),
        F.transform("ends", lambda e: e + F.col("begin")),
        F.when(
            F.col("final") & (F.coalesce("last", "open") < F.col("begin") + F.col("tokens") - 1),
            F.array(F.col("begin") + F.col("tokens")),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    rows = blocks.select("file", "documents", ends.alias("ends"))
    each = F.posexplode(
        F.zip_with(
            F.slice("ends", F.lit(2), F.size("ends")),
            F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))),
            lambda end, start: end - start - 1,
        )
    )
    rows = rows.select("file", "documents", each.alias("place", "n_tokens"))
    return rows.select("file", (F.col("documents") + F.col("place")).alias("document"), "n_tokens")


def documents_token_counts(
    df: DataFrame, key: str, text: str, rank_file: bytes, separator: int
) -> DataFrame:
    """``(key, n_tokens)`` of every document, counted from token files of the whole table.

    The files hold no keys. The tasks that write them number their documents and write
    number and key apart; counts and keys meet by file and number. A difference between
    the two raises. Repeated and NULL keys keep their rows, NULL and empty texts count 0,
    other columns are not read, an empty table gives no rows.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    write_token_files(df, text, rank_file, separator, path, key)
    if df.isEmpty():
        return df.select(F.col(key).alias(key), F.lit(0).cast("long").alias("n_tokens")).limit(0)
    counted = count_tokens(spark, f"{path}/kind=tokens", separator).select(_part("file"), "document", "n_tokens")
    keys = read_keys(spark, path, separator, df.schema[key].dataType).withColumn("known", F.lit(True))
    both = keys.join(counted, ["part", "document"], "full")
    lost = F.raise_error(F.lit("token files and keys differ in their documents")).cast("long")
    n = F.when(F.col("n_tokens").isNull() | F.col("known").isNull(), lost).otherwise(F.col("n_tokens"))
    return both.select(F.col("key").alias(key), n.alias("n_tokens"))
