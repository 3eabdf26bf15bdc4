"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, exact decoding."""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import in_arrow

# Classes of a code point.
LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, ALONE, SPACE = range(8)
# White space of Unicode, fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# States after a code point: a slice is closed, or goes on with letters, numbers, others or
# white space, or waits for what a blank glues to, or for 1 or 2 letters of a contraction.
CLOSED, LETTERS, NUMBERS, OTHERS, SPACES, GLUED, ONE, TWO = range(8)
NO_RANK = 1 << 62
# Working size in code points; more documents than that are cut into slices of rows.
CHUNK = 1 << 19


def _step(state: int, kind: int) -> int:
    if state in (ONE, TWO) and kind == LETTER:  # nothing else can follow there
        return CLOSED if state == ONE else ONE
    if kind in (SHORT, LONG):
        return OTHERS if state in (OTHERS, GLUED) else (ONE if kind == SHORT else TWO)
    return {
        LETTER: LETTERS,
        NUMBER: NUMBERS,
        OTHER: OTHERS,
        GLUE: GLUED,
        ALONE: CLOSED,
        SPACE: SPACES,
    }[kind]


def _begins(state: int, kind: int) -> bool:
    """Whether a code point of this kind begins a slice when it comes in this state."""
    if state in (ONE, TWO):
        return False
    goes_on = {
        LETTER: (LETTERS, GLUED),
        NUMBER: (NUMBERS, GLUED),
        OTHER: (OTHERS, GLUED),
        SHORT: (OTHERS, GLUED),
        LONG: (OTHERS, GLUED),
        GLUE: (),
        ALONE: (),
        SPACE: (SPACES,),
    }
    return state not in goes_on[kind]


# Class that ends every document: whatever came before, the next code point begins anew.
END = 8


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The automaton as the monoid of its transition functions.

    Returns each class's function, the composition table of all functions that arise, the
    state each function leads to from each state, and where a code point begins a slice.
    """
    letters = [tuple(_step(s, k) for s in range(8)) for k in range(8)] + [(CLOSED,) * 8]
    known = {tuple(range(8)): 0}
    for f in letters:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in letters:
            made = tuple(g[x] for x in f)
            if made not in known:
                known[made] = len(known)
                todo.append(made)
    functions = list(known)
    compose = np.array(
        [[known.get(tuple(g[x] for x in f), 0) for g in functions] for f in functions], np.uint8
    )
    of_class = np.array([known[f] for f in letters], np.uint8)
    begins = np.array([[_begins(s, k) for k in range(8)] + [False] for s in range(8)])
    return of_class, compose, np.array(functions, np.uint8), begins


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point without its neighbours."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            table[code] = LETTER
        elif major == "N":
            table[code] = NUMBER
    table[WHITE] = SPACE
    return table


def scan(kinds: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each code point, by an associative scan of transition functions.

    Rows of ``width`` code points are scanned side by side, the rows' totals by doubling,
    and each row's functions are applied to the state that it begins in.
    """
    of_class, compose, leads, _ = tables()
    n = len(kinds)
    rows = -(-n // width)
    grid = np.zeros((width, rows), np.uint8)  # 0 is the identity
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = of_class[kinds]
    by_column = padded.reshape(rows, width).T
    so_far = np.zeros(rows, np.uint8)
    for column in range(width):
        grid[column] = so_far
        so_far = compose[so_far, by_column[column]]
    total, reach = so_far, 1
    while reach < rows:
        total = np.concatenate([total[:reach], compose[total[:-reach], total[reach:]]])
        reach *= 2
    enters = np.full(rows, CLOSED, np.uint8)
    enters[1:] = leads[total[:-1], CLOSED]
    return leads[grid, enters[None, :]].T.reshape(-1)[:n]


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Where slices begin in code points whose documents each end with -1 (as uint32)."""
    end = codes == np.uint32(0xFFFFFFFF)
    kinds = classes()[np.where(end, 0, codes)]
    kinds[end] = END
    following = np.append(kinds[1:], np.uint8(END))
    white = kinds == SPACE
    last = white & (following != SPACE) & (following != END)
    kinds[last] = np.where(codes[last] == 0x20, GLUE, ALONE)
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        after = np.append(codes, np.full(2, 0xFFFFFFFF, np.uint32))
        one, two = after[quote + 1], after[quote + 2]
        kinds[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        kinds[quote[pair]] = LONG
    return tables()[3][scan(kinds), kinds]


class Encoder(dict):
    """Slices of text to the bytes of their ids (little-endian, 32 bits), merged at first
    sight. Starts anew when it holds ``room`` slices, so memory stays bounded."""

    def __init__(self, ranks: dict[bytes, int], room: int = 300_000) -> None:
        super().__init__()
        self.ranks, self.room = ranks, room

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.merged(data)
        made = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:
            self[piece] = made
        return made

    def merged(self, data: bytes) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until no pair has a rank."""
        if len(data) > 100:
            return self._merged_long(data)
        get, bounds = self.ranks.get, list(range(len(data) + 1))
        pairs = [get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < NO_RANK:
            i = pairs.index(least)
            del bounds[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(data[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = get(data[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        return [self.ranks[data[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same by a linked list of parts and a heap of pairs, so that a slice of any
        length takes time in proportion to its length and its logarithm."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [
            (rank, i)
            for i in range(n - 1)
            if (rank := ranks.get(data[i : i + 2])) is not None
        ]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = end[i]
            if not j or j >= n or ranks.get(data[i : end[j]]) != rank:
                continue
            end[i], end[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
                follower = ranks.get(data[i : end[end[i]]])
                if follower is not None:
                    heappush(heap, (follower, i))
            if (h := before[i]) >= 0:
                leader = ranks.get(data[h : end[i]])
                if leader is not None:
                    heappush(heap, (leader, h))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32) and where each text's begin, one more entry."""
        parts, counts = [], [0]
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) < CHUNK):
                size += len(texts[stop]) + 1
                stop += 1
            self._encode_some(texts[start:stop], parts, counts)
            start = stop
        return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(counts)

    def _encode_some(self, texts: list[str], parts: list[bytes], counts: list[int]) -> None:
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4").copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[ends] = 0xFFFFFFFF
        begin = np.flatnonzero(boundaries(codes))
        joined = "\0".join([*texts, ""])
        stops = np.append(begin[1:], len(codes))
        # A slice that ends a document stops before the separator.
        last = np.searchsorted(begin, ends) - 1
        nonempty = (last >= 0) & (np.diff(ends, prepend=-1) > 1)
        stops[last[nonempty]] = ends[nonempty]
        look = self.__getitem__
        pieces = [look(joined[a:b]) for a, b in zip(begin.tolist(), stops.tolist())]
        at = 0
        for stop in np.searchsorted(begin, ends).tolist():
            made = b"".join(pieces[at:stop])
            parts.append(made)
            counts.append(len(made) // 4)
            at = stop


def read_ranks(path: str) -> bytes:
    """The rank file as bytes, read once by the driver and shipped with the tasks. Its size
    is the vocabulary's (about 1 MB), whatever the table's."""
    with open(path, "rb") as file:
        return file.read()


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(rank_file: bytes) -> Encoder:
    """The encoder of a rank file, one for each worker process."""
    mark = hashlib.sha256(rank_file).digest()
    if mark not in _ENCODERS:
        lines = (line.split() for line in rank_file.splitlines() if line)
        _ENCODERS[mark] = Encoder({base64.b64decode(token): int(rank) for token, rank in lines})
    return _ENCODERS[mark]


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end and where each id's begin, one more entry."""
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def encode_texts(df: DataFrame, key: str, text: str, rank_file: bytes) -> DataFrame:
    """``(key, ids, offsets)`` of every row: token ids, packed as little-endian 32-bit
    integers, and the byte of the text where each token begins.

    Slices are those of ``public_tokenizers.PATTERN``, each encoded by itself, without
    special tokens. NULL and empty texts give empty values; NULL and repeated keys keep
    their rows; other columns are not read. Whole texts, any length; one narrow pass.
    """
    schema = f"key {df.schema[key].dataType.simpleString()}, ids binary, offsets array<int>"

    def make(batch: pa.RecordBatch) -> dict:
        own = encoder(rank_file)
        ids, starts = own.encode([x or "" for x in batch["text"].to_pylist()])
        _, begins = _lengths(own)
        size = np.diff(begins)[ids]
        ends = np.cumsum(size)
        rows = np.diff(starts)
        base = np.repeat(np.concatenate([[0], ends])[starts[:-1]], rows)
        packed = ids.astype("<u4").tobytes()
        cuts = (starts * 4).tolist()
        return {
            "key": batch["key"],
            "ids": [packed[a:b] for a, b in zip(cuts, cuts[1:])],
            "offsets": pa.ListArray.from_arrays(
                pa.array(starts.astype(np.int32)), pa.array((ends - size - base).astype(np.int32))
            ),
        }

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return in_arrow(rows, schema, make, rows=500).withColumnRenamed("key", key)


def _lengths(own: Encoder) -> tuple[np.ndarray, np.ndarray]:
    if not hasattr(own, "_tokens"):
        own._tokens = token_bytes(own.ranks)
    return own._tokens


def decode(ids: np.ndarray, own: Encoder) -> bytes:
    """The bytes of a run of ids: a gather over all tokens' bytes."""
    flat, begins = _lengths(own)
    sizes = np.diff(begins)[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


def decode_ids(df: DataFrame, key: str, ids: str, rank_file: bytes) -> DataFrame:
    """``(key, ids, decoded)``: the bytes that each row's packed ids stand for. NULL ids:
    none. An id outside the vocabulary raises."""
    schema = f"key {df.schema[key].dataType.simpleString()}, ids binary, decoded binary"

    def make(batch: pa.RecordBatch) -> dict:
        own = encoder(rank_file)
        return {
            "key": batch["key"],
            "ids": batch["ids"],
            "decoded": [decode(np.frombuffer(x or b"", "<u4"), own) for x in batch["ids"].to_pylist()],
        }

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return in_arrow(rows, schema, make, rows=500).withColumnRenamed("key", key)
