"""Removal of passages that an earlier document holds too, by windows of words.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. Equal hashes are
brought together and counted in Spark, each window that also starts in a document with a
smaller key is marked, and overlapping or touching marked windows merge into maximal
intervals of words to remove.

One row for each window would be most of the work, so windows travel packed: a task deals
the windows of a few megabytes of text, a slice, into buckets by hash, and each (slice,
bucket) is one row. Before that a slice settles what it can alone: of several documents
with one window only the one with the smallest key asks the others. So a passage that a
third of all documents share is one entry for each slice, not for each document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgrove.llm.common import _arrow_schema, joined, slices
from tabgrove.sources.shared import materialise

# Bytes of text in a slice, and windows that a bucket holds on average: layout only.
SLICE = 4 << 20
BUCKET = 1 << 21

# The prime field of the hashes, and one base for each of two hashes.
PRIME = np.uint64(2**61 - 1)
BASES = (0x1B873593CC9E2D51 % (2**61 - 1), 0x0E6546B64F3C6EF3 % (2**61 - 1))

# Rows without a key come after all others.
LAST = 2**63 - 1

_GAP = re.compile(rb"[\x20\x09-\x0D]")

_DEALT = (
    "bucket int, slice long, hashes binary, more binary, low binary, high binary, "
    "docs binary, counts binary, keys binary, marks binary, starts binary, firsts binary, seen binary"
)
_FOUND = "slice long, low binary, high binary, keys binary, marks binary, starts binary, firsts binary, seen binary"
_PASSED = ("keys", "marks", "starts", "firsts", "seen")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of numbers below 2**61 modulo 2**61 - 1."""
    one, low = np.uint64(31), np.uint64(2**31 - 1)
    ah, al, bh, bl = a >> one, a & low, b >> one, b & low
    middle = ah * bl + al * bh
    total = ((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + al * bl
    return _reduced(total + ((middle & np.uint64(2**30 - 1)) << one))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base, made by doubling and kept."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), int(PRIME)))
        have = np.r_[have, _times(have, step)]
    if len(have) <= 1 << 22:
        _POWERS[base] = have
    return have[:n]


def _window_hashes(words: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, below 2**61 - 1, of the ``width`` words from each start on."""
    n = len(words)
    terms = _times(words, _powers(base, n))
    high, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(terms >> np.uint64(30), out=high[1:])
    np.cumsum(terms & np.uint64(2**30 - 1), out=low[1:])
    sums = _reduced(_times(_reduced(high), np.uint64(2**30)) + low)
    between = _reduced(sums[starts + width] + (PRIME - sums[starts]))
    inverse = pow(base, -1, int(PRIME))
    return _times(between, _powers(inverse, n)[starts])


def _word_numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two unrelated numbers below 2**61 - 1 for each word, from 128-bit hashes of the
    distinct words."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    each = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist())
    both = np.frombuffer(each, "<u8").reshape(-1, 2) >> np.uint64(3)
    both = _reduced(both)[coded.indices.to_numpy()]
    return both[:, 0], both[:, 1]


def _pieces(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, list[bytes]]]]:
    """Slices of (key, mark, number of the first word, words).

    A text above the size of a slice continues in the next one, its last words repeated
    by the caller's ``width``; rows without words are left out.
    """
    now, held = [], 0
    for key, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
        data, first = (text or "").encode(), 0
        key = LAST if key is None else key
        begin = 0
        while begin < len(data):
            cut = _GAP.search(data, begin + SLICE)
            end = cut.start() if cut else len(data)
            words = data[begin:end].split()  # at ASCII white space only, as bytes
            if words:
                now.append((key, mark, first, words))
            held, begin, first = held + end - begin, end, first + len(words)
            if held >= SLICE and now:
                yield now
                now, held = [], 0
    if now:
        yield now


def _deal(width: int, buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[int, int, int, list[bytes]] | None = None
        for batch in batches:
            for some in slices(batch, 100_000, SLICE):
                for pieces in _pieces(some):
                    # The end of a text that goes on: windows reach over the cut.
                    if tail and pieces[0][:3] == (*tail[:2], tail[2] + len(tail[3])):
                        pieces[0] = (*tail[:3], tail[3] + pieces[0][3])
                    key, mark, first, words = pieces[-1]
                    back = max(0, len(words) - width + 1)
                    tail = (key, mark, first + back, words[back:])
                    made = _dealt_slice(pieces, width, buckets)
                    if made:
                        yield pa.RecordBatch.from_pylist(made, schema=schema)

    return run


def _dealt_slice(pieces: list, width: int, buckets: int) -> list[dict]:
    """The packed rows of one slice, whose number follows from what it holds."""
    pieces = sorted((p for p in pieces if len(p[3]) >= width), key=lambda p: p[0])
    if not pieces:
        return []
    lengths = np.array([len(p[3]) for p in pieces])
    counts = lengths - width + 1
    starts = np.r_[0, np.cumsum(counts)]
    piece = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(starts[-1]) - starts[piece] + np.r_[0, np.cumsum(lengths)][piece]
    one, two = _word_numbers([w for p in pieces for w in p[3]])
    hashes = _window_hashes(one, at, width, BASES[0])
    other = _window_hashes(two, at, width, BASES[1])
    key = np.array([p[0] for p in pieces], np.int64)

    # Equal windows of the slice stand together, the smallest key first.
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (other[order][1:] != other[order][:-1])
    least = key[piece[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
    seen = np.zeros(len(order), bool)
    seen[order] = key[piece[order]] > least

    asks = np.flatnonzero(~seen)
    bucket = (other[asks] & np.uint64(buckets - 1)).astype(np.uint32)
    deal = np.argsort(bucket, kind="stable")
    asks, bucket = asks[deal], bucket[deal]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    more = (other >> np.uint64(50)).astype(np.uint8)
    own = {
        "keys": key.tobytes(),
        "marks": np.array([p[1] for p in pieces], np.int64).tobytes(),
        "starts": starts.astype(np.int64).tobytes(),
        "firsts": np.array([p[2] for p in pieces], np.int64).tobytes(),
    }
    number = xxhash.xxh3_64_intdigest(b"".join(own.values())) >> 1
    own["seen"] = zlib.compress(np.packbits(seen).tobytes(), 1)
    rows: list[dict] = [{"bucket": number % buckets, "slice": number, **own}]
    for begin, end in zip(edges[:-1], edges[1:]):
        entries = asks[begin:end]
        held = piece[entries]
        change = np.flatnonzero(np.r_[True, held[1:] != held[:-1], True])
        rows.append(
            {
                "bucket": int(bucket[begin]),
                "slice": number,
                "hashes": hashes[entries].tobytes(),
                "more": more[entries].tobytes(),
                "low": entries.astype(np.uint16).tobytes(),
                "high": (entries >> 16).astype(np.uint16).tobytes(),
                "docs": zlib.compress(np.diff(key[held[change[:-1]]], prepend=0).tobytes(), 1),
                "counts": zlib.compress(np.diff(change).astype(np.uint32).tobytes(), 1),
            }
        )
    return rows


def _ask(found: pa.Schema):
    """Of one bucket: the windows that a smaller key has too, by slice."""

    def answer(table: pa.Table) -> pa.Table:
        passed = table.filter(pc.is_valid(table["keys"]))
        table = table.filter(pc.is_null(table["keys"]))
        rows = [
            {"slice": slice_, **{n: passed[n][i].as_py() for n in _PASSED}}
            for i, slice_ in enumerate(passed["slice"].to_pylist())
        ]
        parts = {n: table[n].to_pylist() for n in ("slice", "hashes", "more", "low", "high", "docs", "counts")}
        if parts["slice"]:
            sizes = np.array([len(m) for m in parts["more"]])
            hashes = np.frombuffer(b"".join(parts["hashes"]), "<u8")
            more = np.frombuffer(b"".join(parts["more"]), "u1")
            key = np.concatenate([
                np.repeat(
                    np.cumsum(np.frombuffer(zlib.decompress(d), "<i8")),
                    np.frombuffer(zlib.decompress(c), "<u4"),
                )
                for d, c in zip(parts["docs"], parts["counts"])
            ])
            order = np.lexsort((more, hashes))
            first = np.ones(len(order), bool)
            first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
            least = np.minimum.reduceat(key[order], np.flatnonzero(first))[np.cumsum(first) - 1]
            later = np.zeros(len(order), bool)
            later[order] = key[order] > least
            ends = np.cumsum(sizes)
            for slice_, low, high, begin, end in zip(parts["slice"], parts["low"], parts["high"], ends - sizes, ends):
                hit = later[begin:end]
                if hit.any():
                    low, high = np.frombuffer(low, "<u2")[hit], np.frombuffer(high, "<u2")[hit]
                    rows.append({"slice": slice_, "low": low.tobytes(), "high": high.tobytes()})
        return pa.Table.from_pylist(rows, schema=found)

    return answer


def _merge(width: int, schema: pa.Schema):
    """Of one slice: marked windows as maximal intervals of words, by row."""

    def merged(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next((r for r in rows if r["keys"] is not None), None)
        if own is None:
            raise ValueError("the rows of a slice changed while the query ran; write them first")
        starts = np.frombuffer(own["starts"], "<i8")
        marked = np.unpackbits(np.frombuffer(zlib.decompress(own["seen"]), np.uint8), count=int(starts[-1])).astype(bool)
        for row in rows:
            if row["low"] is not None:
                low, high = np.frombuffer(row["low"], "<u2"), np.frombuffer(row["high"], "<u2")
                marked[low.astype(np.int64) + (high.astype(np.int64) << 16)] = True
        at = np.flatnonzero(marked)
        piece = np.searchsorted(starts, at, side="right") - 1
        word = at - starts[piece] + np.frombuffer(own["firsts"], "<i8")[piece]
        opens = np.ones(len(at), bool)
        opens[1:] = (piece[1:] != piece[:-1]) | (word[1:] > word[:-1] + width)
        begin = np.flatnonzero(opens)
        end = np.r_[begin[1:], len(at)][: len(begin)] - 1
        keys, marks = (np.frombuffer(own[n], "<i8")[piece[begin]] for n in ("keys", "marks"))
        columns = [keys, marks, word[begin], word[end] + width]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return merged


def repeated_spans(df: DataFrame, key: str, text: str, width: int = 50) -> DataFrame:
    """``(key, mark, spans)`` of the rows that repeat a window of a row with a smaller key.

    ``spans`` are maximal intervals of word numbers, ``struct<begin, end>``, end exclusive,
    ascending. ``mark`` is ``xxhash64`` of the text: repeated rows share a result, rows that
    share a key but not the text have their own. ``key`` is an integer; NULL keys count as
    one key above all others. NULL, empty and short texts hold no window. No two windows are
    taken for equal unless 69 bits and more of two independent hashes agree, with one more
    bit for every doubling of the table.

    A slice is named by what it holds, so that a task that runs again makes the same rows.
    ``df`` should be a scan or a written table: where a retry meets other rows, it raises.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    rows = rows.where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = 16
    while buckets * BUCKET * 6 < size:
        buckets *= 2
    dealt = rows.mapInArrow(_deal(width, buckets, _arrow_schema(rows, _DEALT)), _DEALT)
    found = dealt.groupBy("bucket").applyInArrow(_ask(_arrow_schema(rows, _FOUND)), _FOUND)
    schema = "key long, mark long, begin long, end long"
    spans = found.groupBy("slice").applyInArrow(_merge(width, _arrow_schema(rows, schema)), schema)
    # A long text's slices meet here; a window over one row's intervals.
    row = Window.partitionBy("key", "mark").orderBy("begin", "end")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("begin") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0)
    spans = materialise(spans).withColumn("opens", opens).withColumn("span", F.sum("opens").over(row))
    spans = spans.groupBy("key", "mark", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    each = spans.groupBy("key", "mark").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    return each.withColumn("key", F.when(F.col("key") != LAST, F.col("key")))


def remove_repeats(df: DataFrame, key: str, text: str, width: int = 50) -> DataFrame:
    """``(key, n_words, spans, kept)`` per row: the words left, joined by one space.

    Words are runs of code points outside U+0020 and U+0009 to U+000D. A word goes if it
    lies in a window of ``width`` words that also starts in a row with a smaller key;
    windows are judged on the input, so what is removed elsewhere does not matter, and a
    window repeated within one row only stays. A NULL, empty or blank text has no words,
    no spans and the empty string left. Repeated rows (same key and text) keep the same
    words. Other columns are ignored, whatever their names; an empty table gives none.

    Texts are joined with the spans by key once; everything before moves packed windows.
    """
    spans = repeated_spans(df, key, text, width)
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    schema = "key long, n_words long, spans array<struct<begin: bigint, end: bigint>>, kept string"
    # The same plan at every size: spans grow with the table, so they are never broadcast.
    rows = joined(rows, spans.hint("merge"), ["key", "mark"], "left")
    target = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 10_000, SLICE):
                numbers, left = [], []
                for text_, spans_ in zip(some["text"].to_pylist(), some["spans"].to_pylist()):
                    words, kept, at = (text_ or "").encode().split(), [], 0
                    for span in spans_ or []:
                        kept += words[at : span["begin"]]
                        at = span["end"]
                    numbers.append(len(words))
                    left.append(b" ".join(kept + words[at:]).decode())
                empty = pc.coalesce(some["spans"], pa.scalar([], some["spans"].type))
                arrays = [some["key"], pa.array(numbers, pa.int64()), empty, pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return rows.select("key", "text", "spans").mapInArrow(run, schema)
