"""Chat formatting: root-to-leaf paths of reply trees, rendered with a template and a loss mask."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgrove.llm.common import in_arrow, joined, ranked
from tabgrove.sources.shared import materialise

# The template, fixed values: what stands around role and text of each turn.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
# A backslash goes before each of these inside a text, and before a colon in a role too.
CONTROL = re.compile(r"[\\#<]")
ROLE_CONTROL = re.compile(r"[\\#<:]")
TURN = re.compile(
    re.escape(OPEN)
    + r"([^\\#<:]*(?:\\.[^\\#<:]*)*)"
    + re.escape(MIDDLE)
    + r"([^\\#<]*(?:\\.[^\\#<]*)*)"
    + re.escape(CLOSE),
    re.DOTALL,
)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """One conversation as text, and the spans (code points) of the texts of role ``learn``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + ROLE_CONTROL.sub(r"\\\g<0>", role) + MIDDLE
        body = CONTROL.sub(r"\\\g<0>", text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; raises if the text isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        match = TURN.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn begins at code point {at}")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return turns


def choose_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """The nodes on the best root-to-leaf paths of each reply tree.

    ``nodes`` has ``tree``, ``node`` (long, unique in its tree), ``parent`` (NULL: a
    root) and ``score``. Returns ``(tree, leaf, rank, depth, node)``: the ``top`` paths
    of each tree (None: all) by the sum of the scores on them, ties by the smaller leaf;
    ``depth`` counts up from the leaf.

    Self-joins of pointers to the ancestor 1, 2, 4, ... steps up find the sums of all
    paths, in as many rounds as the longest path has doublings; the same tables, from
    the longest step down, then list the nodes of the chosen paths only. All of it works
    on ids; no tree is gathered in a task. A NULL score counts 0, a parent that is
    missing makes its child a root, NULL trees are one tree. Repeated nodes must be told
    apart by the caller, and a cycle of parents raises.
    """
    named = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("total"))
    known = named.where("node IS NOT NULL").select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    state = materialise(joined(named, known, ["tree", "parent"], "left").drop("parent"))
    size = state.count()
    steps = []
    # Only nodes that have not reached their root go on to the next round.
    while not (active := state.where("up IS NOT NULL")).isEmpty():
        if 2 ** len(steps) > size:
            raise ValueError("the parents of a tree form a cycle")
        steps.append(active.select("tree", "node", "up"))
        high = state.where("node IS NOT NULL").select(
            "tree", F.col("node").alias("up"), F.col("total").alias("total2"), F.col("up").alias("up2")
        )
        longer = joined(active, high, ["tree", "up"]).select(
            "tree", "node", (F.col("total") + F.col("total2")).alias("total"), F.col("up2").alias("up")
        )
        state = materialise(longer.unionByName(state.where("up IS NULL")))
    sums = state
    parents = steps[0].select("tree", F.col("up").alias("node")).distinct() if steps else None
    ends = sums if parents is None else joined(sums, parents, ["tree", "node"], "left_anti")
    leaves = ends.select("tree", F.col("node").alias("leaf"), (-F.col("total")).alias("cost"))
    chosen = ranked(leaves, ["cost", "leaf"], group=["tree"], name="rank")
    if top is not None:
        chosen = chosen.where(F.col("rank") < top)
    members = chosen.select(
        "tree", "leaf", "rank", F.lit(0).cast("long").alias("depth"), F.col("leaf").alias("node")
    )
    for k in reversed(range(len(steps))):
        members = materialise(members) if k % 4 == 3 else members
        above = joined(members, steps[k], ["tree", "node"]).select(
            "tree", "leaf", "rank", (F.col("depth") + 2**k).alias("depth"), F.col("up").alias("node")
        )
        members = members.unionByName(above)
    return members


FORMATTED = "tree long, leaf long, rank long, formatted string, loss array<struct<start:int,end:int>>"


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """Render each path of ``choose_paths`` over ``messages(tree, node, role, text)``.

    Returns ``(tree, leaf, rank, formatted, loss)``: ``loss`` has the spans of assistant
    texts in ``formatted``, in code points. A NULL text or role is empty. A conversation
    is one value, so the rows of one path meet in one row; a tree's paths do not.
    """
    turns = joined(paths, messages.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree",
        "leaf",
        "rank",
        F.struct(
            (-F.col("depth")).alias("place"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def make(batch: pa.RecordBatch) -> dict:
        rendered = [
            render([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"].to_pylist()
        ]
        return {name: batch[name] for name in ("tree", "leaf", "rank")} | {
            "formatted": [text for text, _ in rendered],
            "loss": [[{"start": a, "end": b} for a, b in spans] for _, spans in rendered],
        }

    return in_arrow(grouped, FORMATTED, make)


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations in rows by turn as trees without branches, one message after another.

    Returns ``(tree, node, parent, score, role, text)``; ``node`` is the gapless place in
    the conversation. Rows of one turn stand in order of role and the md5 of their text,
    NULL first; repeated rows all stay. NULL conversation ids are one conversation, an
    empty table gives none, other columns are not read. Places are found from ids, turns,
    roles and hashes; texts join them once.
    """
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()))
    narrow = rows.select("tree", "turn", "role", F.md5("text").alias("mark"), "at")
    placed = ranked(narrow, ["turn", "role", "mark"], group=["tree"], name="node")
    return materialise(
        placed.select("tree", "node", "at")
        .join(rows.select("at", "role", "text"), "at")
        .select(
            "tree",
            "node",
            F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"),
            F.lit(1.0).alias("score"),
            "role",
            "text",
        )
    )
