"""Secret scans: patterns, plus literals that reach sensitive names through assignments."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import in_arrow

# Base patterns, fixed values. Letters count as ASCII only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Longer runs only, which the greedy patterns above would find at the same places.
LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

# How sensitive a part of a name is, fixed values.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 1.0,
    "secret": 1.0,
    "token": 1.0,
    "apikey": 1.0,
    "credential": 1.0,
    "credentials": 1.0,
    "auth": 0.7,
    "private": 0.7,
    "key": 0.6,
    "access": 0.5,
    "signing": 0.5,
    "api": 0.4,
}
# Values that only stand for a secret, fixed values.
PLACEHOLDER = re.compile(r"example|changeme|placeholder|dummy|redacted|xxxx|\.\.\.|^(.)\1*$", re.IGNORECASE)
# Bits of a literal from which it counts in full, and the score from which it is reported.
FULL_BITS, REPORTED = 40.0, 0.5

NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*", re.ASCII)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
QUOTED = re.compile(r"""[rbfu]{0,2}("[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')""", re.IGNORECASE)
BARE = re.compile(r"[A-Za-z0-9+/_.=$-]+")
OPERATOR = re.compile(r"[:=]")
# A type between a name's colon and the equals sign: str, Optional[str], &'static str, string | null.
ATOM = r"[A-Za-z_][\w.]{0,80}(?:\[[^\]=\n]{0,80}\]{1,3}|<[^=\n<>]{0,80}(?:<[^=\n<>]{0,80}>)?>)?[?!]?(?:\[\])?"
TYPED = re.compile(rf"[ \t]*(?:&(?:'\w+[ \t]+)?)?({ATOM})(?:[ \t]*\|[ \t]*{ATOM}){{0,8}}[ \t]*=(?![=>~])[ \t]*", re.ASCII)
# A symbol that is the key of a pair, as in ``:password => "..."``.
SYMBOL = re.compile(r":[\"']?[A-Za-z_]\w*[\"']?[ \t]*=>", re.ASCII)
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Whole matches of the base patterns, leftmost and non-overlapping within each kind;
    matches that are too short are dropped after matching."""
    found = [
        ("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]
    ]
    found += [("access", m.start(), m.end()) for m in LONG_ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span: tuple) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def sensitivity(name: str) -> float:
    """How sensitive a name is, 0 to 1: the sum over its camel-case or joined parts."""
    parts = {part.lower() for part in PART.findall(name)}
    return min(1.0, sum(SENSITIVE.get(part, 0.0) for part in parts))


# Counts of a value's characters stop growing here: its bits are far above FULL_BITS then.
MOST = 1 << 40


@dataclass(frozen=True)
class Value:
    """What a value's score and spans need of it, whatever its length.

    ``counts`` of its characters, whether a literal in it is only a ``placeholder``, the
    ``spans`` of its own literals and the values (by number) that it takes over by name.
    """

    counts: dict[str, int]
    placeholder: bool
    spans: tuple[tuple[int, int], ...]
    parts: tuple[int, ...]


def literal(text: str, span: tuple[int, int]) -> Value:
    return Value(dict(Counter(text)), bool(PLACEHOLDER.search(text)), (span,), ())


def joined_value(values: list[Value], named: list[int]) -> Value:
    """Literals and named values one after the other, without their text."""
    longest = max(range(len(values)), key=lambda i: len(values[i].counts))
    counts = dict(values[longest].counts)
    for value in values[:longest] + values[longest + 1 :]:
        for c, n in value.counts.items():
            counts[c] = min(MOST, counts.get(c, 0) + n)
    own = [s for v, at in zip(values, named) if at < 0 for s in v.spans]
    parts = tuple(dict.fromkeys(at for at in named if at >= 0))
    return Value(counts, any(v.placeholder for v in values), tuple(own), parts)


def strength(value: Value) -> float:
    """How much a value looks like a secret, 0 to 1: its bits by the entropy of its
    characters, less for letters alone, nothing for placeholders or white space."""
    n = sum(value.counts.values())
    if n < 8 or value.placeholder or len(value.counts) < 2 or any(c.isspace() for c in value.counts):
        return 0.0
    bits = -sum(c * math.log2(c / n) for c in value.counts.values())
    return min(1.0, bits / FULL_BITS) * (0.4 if all(c.isalpha() for c in value.counts) else 1.0)


def pairs(text: str) -> tuple[list[tuple[str, int]], list[Value]]:
    """Name-literal pairs in order, as names and numbers of values, and the values.

    Reads ``name = value``, ``name := value``, ``name: value``, ``"name": value``, ``name =>
    value`` and ``table["name"] = value`` with quoted or bare values, and ``name: type =
    value`` with quoted values and names of earlier pairs; there the literal is behind the
    type's word too, which may be a name (``else: password = "..."``). A value may join quoted literals and names of earlier pairs by
    ``+`` or by standing next to each other; those names hold their last value, so
    constants reach the names they are assigned to. A value refers to those it takes over:
    what is held grows with the text, not with the lengths of joined values.
    """
    found: list[tuple[str, int]] = []
    values: list[Value] = []
    known: dict[str, int] = {}
    past = 0
    for operator in OPERATOR.finditer(text):
        at = operator.start()
        if at < past or text[at + 1 : at + 2] == "=" and text[at] == "=":
            continue
        end = at
        while end > past and text[end - 1] in " \t":
            end -= 1
        if text[at] == ":":
            if SYMBOL.match(text, at):
                continue
            if end == at and end > past and text[end - 1] in "?!":
                end -= 1
        if end > past and text[end - 1] == "]":
            inner = end - 1
            while inner > past and text[inner - 1] in " \t":
                inner -= 1
            if inner > past and text[inner - 1] in "\"'":
                end = inner
        if end > past and text[end - 1] in "\"'":
            end -= 1
        begin = end
        while begin > past and text[begin - 1] in NAME_CHARS:
            begin -= 1
        name = NAME.fullmatch(text, begin, end)
        if name is None:
            continue
        typed = _typed(text, at, known)
        after = typed.end() if typed else at + 1 + (text[at : at + 2] in (":=", "=>"))
        value, past = _value(text, after, known, values)
        if value is not None:
            if isinstance(value, Value):
                values.append(value)
                value = len(values) - 1
            known[name[0]] = value
            found.append((name[0], value))
            if typed:
                found.append((typed[1], value))
    return found, values


def _typed(text: str, at: int, known: dict) -> re.Match | None:
    """The type behind the colon at ``at`` up to the value, if the value is a quoted literal
    or a known name; else what follows the colon is itself the value."""
    typed = TYPED.match(text, at + 1) if text[at] == ":" else None
    if typed and not QUOTED.match(text, typed.end()):
        bare = BARE.match(text, typed.end())
        return typed if bare and bare[0] in known else None
    return typed


def _value(
    text: str, at: int, known: dict[str, int], values: list[Value]
) -> tuple[Value | int | None, int]:
    """The value that begins at ``at``, and where reading stopped: a new one, the number of
    one that it is by name alone, or None."""
    pieces: list[Value] = []
    named: list[int] = []
    stop = at
    while True:
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if quoted := QUOTED.match(text, at):
            begin, at = quoted.start(1) + 1, quoted.end()
            pieces.append(literal(text[begin : at - 1], (begin, at - 1)))
            named.append(-1)
        elif (bare := BARE.match(text, at)) and text[bare.end() : bare.end() + 1] not in ("(", "[", ":"):
            if bare[0] in known:
                at = bare.end()
                pieces.append(values[known[bare[0]]])
                named.append(known[bare[0]])
            elif not pieces:
                at = bare.end()
                return literal(bare[0], (bare.start(), at)), at
            else:
                break
        else:
            break
        stop = at
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if text[at : at + 1] == "+":
            at += 1
    if len(named) == 1 and named[0] >= 0:
        return named[0], stop
    return (joined_value(pieces, named) if pieces else None), stop


def literal_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """Literals behind sensitive names, ``("literal", start, end, name, score)``; the score
    is the name's sensitivity times the whole value's strength.

    A value's best name is handed on to the values it takes over, the last ones first, so
    each value is looked at once however often it is named.
    """
    best: dict[tuple[int, int], tuple[float, str]] = {}
    if "=" in text or ":" in text:
        found, values = pairs(text)
        scores: dict[int, tuple[float, str]] = {}
        for name, at in found:
            score = sensitivity(name)
            if score >= REPORTED and (score := score * strength(values[at])) >= REPORTED:
                scores[at] = max(scores.get(at, (0.0, "")), (score, name))
        for at in range(max(scores, default=-1), -1, -1):
            if own := scores.get(at):
                for part in values[at].parts:
                    scores[part] = max(scores.get(part, (0.0, "")), own)
                for span in values[at].spans:
                    if span[0] < span[1]:
                        best[span] = max(best.get(span, (0.0, "")), own)
    return [("literal", *span, name, score) for span, (score, name) in best.items()]


def spans_of(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """All spans by start, then kind. A literal inside a base span is not added."""
    base = base_spans(text)
    starts, reach = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
    added = []
    for span in literal_spans(text):
        before = bisect_right(starts, span[1])
        if not before or reach[before - 1] < span[2]:
            added.append(span)
    return sorted([(*span, None, 1.0) for span in base] + added, key=_place)


SPANS = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def scan_secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, spans)`` of every row: kind, start, end (code points), name and score.

    One narrow pass over whole texts. NULL and empty texts have no spans, NULL and
    repeated keys and repeated rows keep their rows, other columns are not read, an empty
    table gives no rows.
    """
    schema = f"key {df.schema[key].dataType.simpleString()}, spans {SPANS}"

    def make(batch: pa.RecordBatch) -> dict:
        names = ("kind", "start", "end", "name", "score")
        found = [
            [dict(zip(names, span)) for span in spans_of(x or "")] for x in batch["text"].to_pylist()
        ]
        return {"key": batch["key"], "spans": found}

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return in_arrow(rows, schema, make).withColumnRenamed("key", key)


def redact_secrets(df: DataFrame, text: str, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mask``; other columns stay.

    Overlapping spans become one. NULL texts stay NULL, texts without a span unchanged;
    rows keep their number, an empty table stays empty, columns may have any names.
    """
    place = df.columns.index(text)
    schema = ", ".join(f"c{i} {field.dataType.simpleString()}" for i, field in enumerate(df.schema))

    def masked(body: str | None) -> str | None:
        spans = spans_of(body or "")
        if not spans:
            return body
        parts, at = [], 0
        for _, start, end, *_ in spans:
            if start >= at:
                parts += (body[at:start], mask)
            at = max(at, end)
        return "".join([*parts, body[at:]])

    def make(batch: pa.RecordBatch) -> dict:
        made = {f"c{i}": batch.column(i) for i in range(batch.num_columns)}
        return made | {f"c{place}": [masked(x) for x in batch.column(place).to_pylist()]}

    return in_arrow(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), schema, make).toDF(*df.columns)
