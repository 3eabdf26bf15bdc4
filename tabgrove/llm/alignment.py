"""Alignment of two tokenizers' tokens over the same bytes, and corpus counts of their links.

Both tokenizers cut the bytes of a text into intervals. All of them are sorted by start and
the running maximum of their ends is taken: where a start reaches it, no token reaches over
that offset, and a group of tokens ends. Within a group, tokens whose ranges overlap are
expanded into pairs; those that end together are links.

A task aligns a few megabytes of text, a slice, at a time. Both tokenizers always end a
token before a single space between words, so texts are cut into chunks there and each
distinct chunk of a slice is encoded and aligned once. Links go by their place in the
slice's list of distinct id pairs, so one row for each slice and distinct pair is shuffled
to be counted, and one brings the counts back.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import _arrow_schema, slices

# Bytes of text in a slice, and in what one call encodes: layout only.
SLICE = 4 << 20
CALL = 1 << 13

_ALIGNED = (
    "slice long, place int, key long, n_a long, n_b long, n_groups long, n_links long, "
    "groups string, links binary, pairs binary, pair_counts binary"
)


class Tokenizers:
    """The two vocabularies' files as bytes, shipped with the tasks (2 MB)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        with open(path_a, "rb") as a, open(path_b, "rb") as b:
            self.a, self.b = a.read(), b.read()


@lru_cache(maxsize=1)
def _loaded(file_a: bytes, file_b: bytes):
    """Encoders, each id's bytes, their lengths, and each id's decimals with what may
    follow it in the text of groups."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(file_a.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
    shown = {c: i for i, c in enumerate(_byte_letters())}
    vocabulary = a.get_vocab(with_added_tokens=True)
    bytes_a = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        bytes_a[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.get_piece_size())
    ]
    sizes = [np.array([len(t) for t in table], np.int64) for table in (bytes_a, bytes_b)]
    told = [f"{i}{sep}" for table, seps in ((bytes_a, ",|"), (bytes_b, ",;")) for sep in seps for i in range(len(table))]
    return a, b, bytes_a, bytes_b, sizes, told


def _byte_letters() -> list[str]:
    """The letter that shows each byte in a byte-level vocabulary: printable Latin-1 bytes
    show themselves, the others take code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(i) if i in own else chr(next(rest)) for i in range(256)]


# Where both tokenizers end a token whatever follows: before a single space between two
# code points that are no white space (Python's is the wider notion of it).
_BREAK = re.compile(r"(?<=\S) (?=\S)")


class _Encoder:
    """Encodes chunks, many in one text, and tells which are spelt."""

    def __init__(self, files: Tokenizers) -> None:
        self.a, self.b, self.bytes_a, self.bytes_b, self.sizes, _ = _loaded(files.a, files.b)

    def one(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids by A of space and text, and by B, which adds the space itself; None if
        either does not spell space and text."""
        ids_a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        ids_b, whole = self.b.encode(text), b" " + text.encode()
        same_a = b"".join(map(self.bytes_a.__getitem__, ids_a)) == whole
        return (ids_a, ids_b) if same_a and b"".join(map(self.bytes_b.__getitem__, ids_b)) == whole else None

    def all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A and by B of the spelt chunks, end to end, and which chunks are spelt.

        Chunks without white space at their ends are encoded together, joined by spaces,
        as text cut into them would be; the others, and a text that is not spelt, one by
        one.
        """
        ids_a, ids_b, spelt = [], [], np.ones(len(chunks), bool)
        inner = [not (c[0].isspace() or c[-1].isspace()) for c in chunks]
        begin = 0
        while begin < len(chunks):
            end, held = begin, 0
            while end < len(chunks) and held < CALL and (end == begin or inner[end - 1] and inner[end]):
                held, end = held + len(chunks[end]) + 1, end + 1
            made = self.one(" ".join(chunks[begin:end]))
            for i in [] if made else range(begin, end):
                own = self.one(chunks[i])
                spelt[i] = own is not None
                ids_a += own[0] if own else []
                ids_b += own[1] if own else []
            if made:
                ids_a += made[0]
                ids_b += made[1]
            begin = end
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64), spelt


def coalesced(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all intervals by start (ties: by kind) and each one's group in that order.

    A group breaks where a start reaches the greatest end before it.
    """
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def overlapping(
    start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in A and B whose intervals overlap; both tile the same bytes, so
    none reaches beyond its group."""
    first = np.searchsorted(end_b, start_a, side="right")
    count = np.searchsorted(start_b, end_a, side="left") - first
    left = np.repeat(np.arange(len(start_a)), count)
    before = np.repeat(np.cumsum(count) - count, count)
    return left, np.arange(len(left)) - before + np.repeat(first, count)


class _Chunks:
    """Tokens, groups and links of distinct chunks of text, laid end to end.

    ``spelt`` tells the chunks whose tokens of both kinds give back space and chunk; the
    others have no tokens here. Every chunk's tokens end at its end, so groups and links
    stay within chunks.
    """

    def __init__(self, chunks: list[str], files: Tokenizers) -> None:
        told, (size_a, size_b) = _loaded(files.a, files.b)[5], _loaded(files.a, files.b)[4]
        ids_a, ids_b, self.spelt = _Encoder(files).all(chunks)
        n = len(chunks)
        # A spelt chunk's tokens end where its bytes do, in both.
        reach = np.cumsum([len(c.encode()) + 1 if s else 0 for c, s in zip(chunks, self.spelt.tolist())])
        end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
        start_a, start_b = end_a - size_a[ids_a], end_b - size_b[ids_b]
        counts = np.diff([np.searchsorted(end, np.r_[0, reach], side="right") for end in (end_a, end_b)], axis=1)
        kind = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order, group = coalesced(np.r_[start_a, start_b], np.r_[end_a, end_b], kind)

        # Each token's decimals with its separator, group by group, A before B.
        kind = kind[order]
        by_kind = np.argsort(group * 2 + kind, kind="stable")
        at, group, kind = order[by_kind], group[by_kind], kind[by_kind]
        closes = np.ones(len(at), bool)
        closes[:-1] = (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])
        entry = np.r_[ids_a, ids_b + 2 * len(size_a)][at]
        entry += closes * np.where(kind, len(size_b), len(size_a))
        words, total = list(map(told.__getitem__, entry.tolist())), counts.sum(axis=0)
        ends = np.cumsum(total)
        self.groups = ["".join(words[e - m : e])[:-1] for e, m in zip(ends.tolist(), total.tolist())]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(np.searchsorted(ends, first, side="right"), minlength=n)
        self.n_a, self.n_b = counts

        left, right = overlapping(start_a, end_a, start_b, end_b)
        together = end_a[left] == end_b[right]
        left, right = left[together], right[together]
        self.pairs = ids_a[left] * len(size_b) + ids_b[right]
        self.n_links = np.bincount(np.searchsorted(np.cumsum(counts[0]), left, side="right"), minlength=n)


def _gathered(values: np.ndarray, counts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs of ``values``, of the given lengths, that ``index`` names, end to end."""
    sizes = counts[index]
    shift = np.repeat((np.cumsum(counts) - counts)[index] - np.cumsum(sizes) + sizes, sizes)
    return values[np.arange(len(shift)) + shift]


def _aligned_slice(number: int, keys: list, texts: list[str | None], files: Tokenizers) -> dict[str, list]:
    """One row for each text. Chunks that the slice repeats are encoded and aligned once."""
    cut = [_BREAK.split(text) if text else [] for text in texts]
    words = pa.array([w for some in cut for w in some], pa.large_string()).dictionary_encode()
    chunks, index = _Chunks(words.dictionary.to_pylist(), files), words.indices.to_numpy()
    sizes = np.array([len(some) for some in cut])
    text_of = np.repeat(np.arange(len(texts)), sizes)
    whole = np.bincount(text_of, ~chunks.spelt[index], minlength=len(texts)) == 0
    index, text_of = index[whole[text_of]], text_of[whole[text_of]]
    sizes = np.where(whole, sizes, 0)

    def added(values: np.ndarray) -> np.ndarray:
        return np.bincount(text_of, values[index], minlength=len(texts)).astype(np.int64)

    distinct, place = np.unique(chunks.pairs, return_inverse=True)
    place = _gathered(place.astype("<u2" if len(distinct) <= 1 << 16 else "<u4"), chunks.n_links, index)
    n_links = added(chunks.n_links)
    listed, ends, link_ends = index.tolist(), np.cumsum(sizes).tolist(), np.cumsum(n_links).tolist()
    rest = [None] * (len(texts) - 1)
    return {
        "slice": [number] * len(texts),
        "place": list(range(len(texts))),
        "key": keys,
        "n_a": added(chunks.n_a),
        "n_b": added(chunks.n_b),
        "n_groups": added(chunks.n_groups),
        "n_links": n_links,
        "groups": [
            ";".join(map(chunks.groups.__getitem__, listed[e - n : e])) for e, n in zip(ends, sizes.tolist())
        ],
        "links": [place[e - n : e].tobytes() for e, n in zip(link_ends, n_links.tolist())],
        "pairs": [distinct.astype("<i8").tobytes(), *rest],
        "pair_counts": [np.bincount(place, minlength=len(distinct)).astype("<i8").tobytes(), *rest],
    }


def align_texts(df: DataFrame, key: str, text: str, files: Tokenizers) -> DataFrame:
    """Groups and links of every row, slice by slice; see ``_ALIGNED``.

    ``groups`` lists A ids, ``|`` and B ids of each group, groups separated by ``;``.
    ``links`` are places in ``pairs``, which with ``pair_counts`` stands in the first row
    of each slice: distinct ``id_a * (number of B ids) + id_b`` and their links there.

    A row whose text is NULL or empty, or whose tokens of either kind do not spell space
    and text, has no tokens. Special tokens' strings are plain text. Repeated rows come
    out each, a NULL key stays NULL, other columns are ignored, an empty table gives none.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    target = _arrow_schema(df, _ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, 20_000, SLICE):
                made = _aligned_slice(number, some.column(0).to_pylist(), some.column(1).to_pylist(), files)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    return rows.mapInArrow(run, _ALIGNED)


def pair_totals(aligned: DataFrame, n_b: int) -> DataFrame:
    """``(pair, links, best)`` of each id pair: its links in all rows, and whether no other
    pair of its B id has more. ``aligned`` is a written table of ``align_texts``."""
    totals = _slice_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("links"))
    totals = totals.withColumn("b", F.col("pair") % n_b)
    most = totals.groupBy("b").agg(F.max("links").alias("most"))
    return totals.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def _slice_pairs(aligned: DataFrame) -> DataFrame:
    schema = "slice long, at int, pair long, n long"
    target = _arrow_schema(aligned, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pairs, n = np.frombuffer(pairs, "<i8"), np.frombuffer(n, "<i8")
                columns = [np.full(len(n), number), np.arange(len(n), dtype=np.int32), pairs, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    own = aligned.where("pairs IS NOT NULL").select("slice", "pairs", "pair_counts")
    return own.mapInArrow(run, schema)


def count_links(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows of a written table of ``align_texts`` with ``n_best``, the links whose pair is
    its B id's most frequent (ties included), and ``count_sum``, their pairs' links added.

    A slice's rows and the totals of its pairs meet in one task.
    """
    back = _slice_pairs(aligned).join(totals, "pair").select("slice", "at", "links", "best")
    kept = [c for c in aligned.columns if c not in {"slice", "place", "links", "pairs", "pair_counts"}]
    own = aligned.select("slice", *kept, F.col("links").alias("places"))
    fields = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = ", ".join([*(f"`{n}` {fields[n]}" for n in kept), "n_best long", "count_sum long"])
    target = _arrow_schema(aligned, schema)

    def meet(rows: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts["at"].to_numpy()
        links, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        links[at], best[at] = counts["links"].to_numpy(), counts["best"].to_numpy().astype(np.int64)
        sums = [np.zeros(len(rows), np.int64) for _ in range(2)]
        kind = "<u2" if len(at) <= 1 << 16 else "<u4"
        for i, places in enumerate(rows["places"].to_pylist()):
            own = np.frombuffer(places, kind)
            sums[0][i], sums[1][i] = best[own].sum(), links[own].sum()
        columns = [rows[n].combine_chunks() for n in kept] + [pa.array(s) for s in sums]
        return pa.Table.from_arrays([pc.cast(c, f.type) for c, f in zip(columns, target)], schema=target)

    return own.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(meet, schema)


def vocabulary_size(files: Tokenizers) -> int:
    """Number of B's ids, by which pairs are numbered."""
    return len(_loaded(files.a, files.b)[3])
