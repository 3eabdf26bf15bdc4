"""N-gram Jaccard join: grouped prefixes, group pairs filtered, members expanded and verified."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgrove.llm.common import chained, components, in_arrow, merged, ranked, run_hashes, slices, squeezed, summed, utf8
from tabgrove.sources.shared import materialise

WORDS, PERCENT = 5, 80
# Shingles counted together in a task, and how often one must be seen to come later in the
# order. The order only decides how many candidates there are, never which pairs are found.
COUNTED, FREQUENT = 1 << 21, 16
# Bits of the table that says which shingles come later, for each of three levels.
TABLE_BITS, LEVELS = 24, 3
# Rows of one side of a block of a long list, and pairs looked at together in a task.
BLOCK, PAIRS = 2048, 1 << 20


def shingle_sets(batch: pa.RecordBatch, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, and two hashes of its word sequence.

    A-Z in lower case; words end at blanks and ASCII white space. With fewer words than a
    shingle the whole sequence is one; without words the set is empty.
    """
    data, start, _, first = squeezed(*utf8(batch["text"]))
    n = np.diff(first)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(n)), size)
    head = first[:-1][of] + np.arange(begin[-1]) - begin[:-1][of]
    each = run_hashes(data, start)
    hashes = chained(each[0], head, np.minimum(n, words)[of])
    sets = [np.unique(hashes[a:b]) for a, b in zip(begin.tolist(), begin[1:].tolist())]
    h1, h2 = (np.where(n > 0, summed(each[i], first), 0).astype(np.uint64) for i in (0, 1))
    return sets, h1, h2


PROFILE = "kind string, key {key}, h1 long, h2 long, n long"


def profiles(df: DataFrame, words: int) -> DataFrame:
    """Rows of kind ``doc`` (key, hashes of the word sequence, set size) and ``seen``
    (a shingle hash and how often different texts of one run of a task held it, from 2)."""

    def run(batches):
        known: set = set()
        held: list[np.ndarray] = []
        total = 0

        def seen():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            empty = pa.nulls(len(values))
            return rows("seen", empty.cast(key_type), values, np.zeros(len(values), np.uint64), counts)

        for batch in batches:
            for some in slices(batch):
                sets, h1, h2 = shingle_sets(some, words)
                yield rows("doc", some["key"], h1, h2, [len(s) for s in sets])
                for s, mark in zip(sets, zip(h1.tolist(), h2.tolist())):
                    if len(s) and mark not in known:
                        known.add(mark)
                        held.append(s)
                        total += len(s)
                if total >= COUNTED:
                    yield seen()
                    known.clear()
                    held.clear()
                    total = 0
        if held:
            yield seen()

    def rows(kind, key, a, b, n):
        key = key.cast(key_type)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(key), pa.string()), key, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n, pa.int64())],
            names=["kind", "key", "h1", "h2", "n"],
        )

    kind = df.schema["key"].dataType.simpleString()
    key_type = pa.int32() if kind == "int" else pa.int64()
    return df.mapInArrow(run, PROFILE.format(key=kind))


def frequency_table(profile: DataFrame) -> np.ndarray:
    """A level for each of 2**TABLE_BITS hash prefixes: 0, or higher the more often a
    shingle with that prefix was seen. Its size is fixed, whatever the corpus."""
    seen = profile.where("kind = 'seen'").groupBy("h1").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(LEVELS), F.floor(F.log2(F.col("n") / FREQUENT) / 2) + 1).cast("int")
    place = F.shiftrightunsigned("h1", 64 - TABLE_BITS)
    often = seen.where(F.col("n") >= FREQUENT).select(level.alias("level"), place.alias("place"))
    words = often.groupBy("level", F.shiftright("place", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))")).alias("bits")
    )
    found = words.toArrow()
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    for level_ in range(1, LEVELS + 1):
        these = found.filter(pc.equal(found["level"], level_))
        bits = marked(these["word"], these["bits"])
        np.putmask(table, np.unpackbits(bits.view(np.uint8), bitorder="little"), level_)
    fours = table.reshape(-1, 4)
    return fours[:, 0] << 6 | fours[:, 1] << 4 | fours[:, 2] << 2 | fours[:, 3]


def marked(word: pa.ChunkedArray, bits: pa.ChunkedArray) -> np.ndarray:
    """A table of 2**TABLE_BITS bits from those of its 32-bit words that are not 0."""
    table = np.zeros(1 << TABLE_BITS - 5, "<u4")
    table[word.to_numpy()] = bits.to_numpy().astype("<u4")
    return table


def parity(values: np.ndarray, share: float) -> bytes:
    """For each of a power of two of places, whether an odd number of a set's hashes falls
    there. Two sets differ in at least as many members as their parities differ in; the
    more places (``share`` for each member at least), the closer that is."""
    width = 1 << max(6, math.ceil(math.log2(len(values) * share)))
    odd = np.bincount((values % np.uint64(width)).astype(np.int64), minlength=width) % 2
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix_rows(df: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """``(h1, h2, n, cold, prefix, parity, fine)`` of each different text of a slice, with
    a short and a long parity.

    The prefix has the first n - ceil(percent * n / 100) + 1 shingles of the set, rare
    ones first: two sets that reach the threshold share one of them. The first ``cold``
    of it are not frequent.
    """

    def make(batch: pa.RecordBatch) -> dict | None:
        sets, h1, h2 = shingle_sets(batch, words)
        _, first = np.unique(np.stack([h1, h2]), axis=1, return_index=True)
        chosen = [i for i in first.tolist() if len(sets[i])]
        prefixes, cold, coarse, fine = [], [], [], []
        for i in chosen:
            s = sets[i]
            place = s >> np.uint64(64 - TABLE_BITS)
            level = levels[place >> np.uint64(2)] >> (6 - 2 * (place & np.uint64(3))).astype(np.uint8) & 3
            length = len(s) - -(-percent * len(s) // 100) + 1
            order = np.argsort(level, kind="stable")[:length]
            prefixes.append(s[order].view(np.int64))
            cold.append(int((level[order] == 0).sum()))
            coarse.append(parity(s, 0.5))
            fine.append(parity(s, 4.0))
        return {
            "h1": h1.view(np.int64)[chosen],
            "h2": h2.view(np.int64)[chosen],
            "n": [len(sets[i]) for i in chosen],
            "cold": cold,
            "prefix": pa.array(prefixes, pa.list_(pa.int64())),
            "parity": coarse,
            "fine": fine,
        }

    schema = "h1 long, h2 long, n long, cold long, prefix array<long>, parity binary, fine binary"
    return in_arrow(df, schema, make)


def with_least(lists: DataFrame, value: str, name: str) -> DataFrame:
    """Lists of two values or more, with the least and the greatest ``value`` of each.

    Lists of rare shingles are gathered by a window. Frequent ones are summed up before
    they are shuffled and joined back, which Spark splits where a list is skewed.
    """
    whole = Window.partitionBy("token")
    rare = lists.where("rare").withColumns(
        {f"{name}_low": F.min(value).over(whole), f"{name}_high": F.max(value).over(whole)}
    )
    often = lists.where("NOT rare")
    ends = often.groupBy("token").agg(F.min(value).alias(f"{name}_low"), F.max(value).alias(f"{name}_high"))
    both = rare.unionByName(merged(often, ends, "token").select(*rare.columns))
    return both.where(f"{name}_low <> {name}_high")


def verified(
    df: DataFrame, pairs: DataFrame, contents: DataFrame, words: int, percent: int
) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that reach the threshold, by their whole sets.

    Only texts that are in a pair are read again; the others are passed over by a table of
    fixed size over hashed keys. Sets are sent to the pair's second node, then to its first.
    """
    wanted = materialise(
        merged(
            pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(),
            contents,
            "node",
        ).select("node", "rep", "h1", "h2")
    )
    place = F.shiftrightunsigned(F.xxhash64("rep"), 64 - TABLE_BITS)
    words_ = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("bits")
    )
    found = words_.toArrow()
    table = marked(found["word"], found["bits"])

    def make(batch: pa.RecordBatch) -> dict | None:
        at = batch["place"].to_numpy()
        chosen = np.flatnonzero((table[at >> 5] >> (at & 31).astype("<u4")) & 1)
        if not len(chosen):
            return None
        some = batch.take(pa.array(chosen))
        sets, h1, h2 = shingle_sets(some, words)
        return {
            "key": some["key"],
            "h1": h1.view(np.int64),
            "h2": h2.view(np.int64),
            "members": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
        }

    hashed = df.withColumn("place", F.shiftrightunsigned(F.xxhash64("key"), 64 - TABLE_BITS))
    kind = df.schema["key"].dataType.simpleString()
    found = in_arrow(hashed, f"key {kind}, h1 long, h2 long, members array<long>", make)
    sets = wanted.join(found.hint("merge"), (wanted.rep.eqNullSafe(found.key)) & (wanted.h1 == found.h1) & (wanted.h2 == found.h2))
    sets = materialise(sets.select("node", "members").groupBy("node").agg(F.first("members").alias("members")))
    second = merged(pairs, sets.toDF("b", "of_b"), "b")
    both = merged(second, sets.toDF("a", "of_a"), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return materialise(both.where(100 * common >= percent * union).select("a", "b"))


def unlike(a: bytes, b: bytes) -> int:
    """The least number of members in which two sets can differ, by their parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def most_unlike(sizes, percent: int):
    """How many members two sets of that total size may differ in, at the threshold."""
    return sizes * (100 - percent) // (100 + percent)


def possible(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and parities allow the threshold."""
    left = contents.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    right = contents.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    joined = merged(merged(pairs, left, "a"), right, "b").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    )

    def make(batch: pa.RecordBatch) -> dict:
        most = most_unlike(batch["na"].to_numpy() + batch["nb"].to_numpy(), percent)
        least = [unlike(x, y) for x, y in zip(batch["pa"].to_pylist(), batch["pb"].to_pylist())]
        keep = pa.array(np.array(least, np.int64) <= most)
        return {name: batch[name].filter(keep) for name in ("a", "b")}

    return in_arrow(joined, "a long, b long", make, rows=20_000)


def across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one list and of different components that sizes and parities allow.

    ``lists`` has token, node, component, n and parity. A long list is dealt into bands of
    sizes, such that sets which reach the threshold lie in one band or in neighbours, and
    each band into blocks; a pair of blocks is a group of its own. A task looks at the
    pairs of its groups and sends on only those that may be links.
    """
    # A little wider than the ratio that sizes may have, so that rounding does no harm.
    width = max(1e-6, -math.log(percent / 100) + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    rows = lists.withColumn("band", band)
    bands = rows.groupBy("token", "band").agg(F.count("*").alias("m"))
    sizes = bands.groupBy("token").agg(
        F.sum("m").alias("m"),
        F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / BLOCK).cast("int")))).alias("blocks"),
    )
    sizes = sizes.withColumn("blocks", F.when(F.col("m") > BLOCK, F.col("blocks")))
    rows = merged(rows, sizes.drop("m"), "token")

    def block(band_: Column, number: Column) -> Column:
        return F.shiftleft(band_.cast("long"), 32) + number

    def blocks_of(band_: Column) -> Column:
        """Numbers of a band's blocks; a band that the list lacks has none."""
        held = F.coalesce(F.try_element_at("blocks", band_), F.lit(0))
        every = F.transform(F.sequence(F.lit(0), held - 1), lambda i: block(band_, i))
        return F.when(held > 0, every).otherwise(F.array().cast("array<bigint>"))

    here = F.col("band")
    own = block(here, F.pmod(F.xxhash64("node", "token"), F.element_at("blocks", here)))
    near = F.concat(*(blocks_of(here + step) for step in (-1, 0, 1)))
    whole = F.col("blocks").isNull()
    rows = rows.withColumn("own", F.when(whole, F.lit(0).cast("long")).otherwise(own))
    rows = rows.withColumn("other", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(near)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    group = ["token", "low", "high"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group, "n")
    dealt = dealt.select(*group, "own", "node", "component", "n", "parity")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            table = table.combine_chunks()
            cut = last_group(table)
            if cut:
                yield from compared(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield from compared(rest)

    def last_group(table) -> int:
        marks = [table[c].to_numpy() for c in group]
        other = np.zeros(table.num_rows, bool)
        for m in marks:
            other |= m != m[-1]
        at = np.flatnonzero(other)
        return int(at[-1]) + 1 if len(at) else 0

    def compared(table):
        if table.num_rows < 2:
            return
        table = table.combine_chunks()
        marks = [table[c].to_numpy() for c in group]
        starts = np.ones(table.num_rows, bool)
        starts[1:] = False
        for m in marks:
            starts[1:] |= m[1:] != m[:-1]
        first = np.flatnonzero(starts)
        stop = np.repeat(np.append(first[1:], table.num_rows), np.diff(np.append(first, table.num_rows)))
        n, own, part, node = (table[c].to_numpy() for c in ("n", "own", "component", "node"))
        across_blocks = marks[1] != marks[2]
        # Rows are sorted by size, so a row's partners end where sizes pass the threshold.
        limit = n * 100 // percent
        partners = np.zeros(table.num_rows, np.int64)
        for a, b in zip(first.tolist(), np.append(first[1:], table.num_rows).tolist()):
            partners[a:b] = np.searchsorted(n[a:b], limit[a:b], side="right") + a
        count = np.minimum(partners, stop) - np.arange(table.num_rows) - 1
        parities = table["parity"].to_pylist()
        ends = np.cumsum(count)
        row = 0
        while row < table.num_rows:
            until = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS)))
            c = count[row:until]
            i = np.repeat(np.arange(row, until), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            keep = (part[i] != part[j]) & (~across_blocks[i] | (own[i] != own[j]))
            i, j = i[keep], j[keep]
            most = most_unlike(n[i] + n[j], percent)
            good = parity_close(parities, i, j, most)
            i, j = node[i[good]], node[j[good]]
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"]
                )
            row = until

    return dealt.mapInArrow(run, "a long, b long")


def parity_close(parities: list[bytes], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs' parities differ in at most ``most`` places; pairs of equal widths are
    compared as arrays."""
    good = np.zeros(len(i), bool)
    if not len(i):
        return good
    width = np.array([len(p) for p in parities])
    for w in np.unique(np.minimum(width[i], width[j])).tolist():
        these = np.flatnonzero(np.minimum(width[i], width[j]) == w)
        used, place = np.unique(np.concatenate([i[these], j[these]]), return_inverse=True)
        folded = np.stack(
            [np.bitwise_xor.reduce(np.frombuffer(parities[u], np.uint8).reshape(-1, w), axis=0) for u in used]
        )
        a, b = place[: len(these)], place[len(these) :]
        for at in range(0, len(these), max(1, (1 << 25) // w)):
            s = slice(at, at + max(1, (1 << 25) // w))
            differ = np.bitwise_count(folded[a[s]] ^ folded[b[s]]).sum(axis=1, dtype=np.int64)
            good[these[s]] = differ <= most[these[s]]
    return good


def jaccard_components(
    df: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row: set size, and the smallest key
    reachable over pairs of texts with a Jaccard similarity of ``percent`` or more.

    Texts of equal words are one content; contents of equal size and prefix are one
    group. Each prefix shingle lists the groups that have it. First every group of a list
    is paired with the list's first, and every member with its group's first, and what
    sizes and parities allow is verified on whole sets: most copies are then connected.
    Then lists and groups that still hold different components are expanded to members,
    and the pairs between components are filtered and verified in the same way. Pairs
    within a component can't change it, so none is left out that matters.

    NULL and empty texts, and texts without words, have size 0 and link with nothing.
    Rows of one key keep their rows; NULL keys too, their component is NULL if no other
    key is reachable. Other columns are not read, an empty table gives no rows. Shingles
    are compared by 64-bit hashes, equal texts by two.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    profile = materialise(profiles(docs, words))
    levels = frequency_table(profile)
    each = profile.where("kind = 'doc'").drop("kind")
    found = each.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("key").alias("rep"))
    nodes = ranked(found, ["rep", "h1", "h2"], name="node").drop("n")
    rows = prefix_rows(docs, levels, words, percent)
    rows = merged(rows, nodes, ["h1", "h2"]).withColumn("p1", F.xxhash64("prefix")).withColumn(
        "p2", F.xxhash64(F.lit(1), "prefix")
    )
    # A content that several tasks have seen comes once from each.
    contents = materialise(rows.dropDuplicates(["h1", "h2"]))
    marks = ["n", "p1", "p2"]
    leaders = contents.groupBy(*marks).agg(F.min("node").alias("leader"))
    members = materialise(merged(contents, leaders, marks).select("node", "leader"))

    lead = merged(contents, members.where("node = leader").select("node"), "node")
    listed = lead.select("node", "cold", F.posexplode("prefix").alias("place", "token"))
    listed = listed.select("token", "node", (F.col("place") < F.col("cold")).alias("rare"))
    lists = materialise(with_least(listed, "node", "node").select("token", "node", "rare", "node_low"))
    hubs = lists.where("node <> node_low").select(F.col("node_low").alias("a"), F.col("node").alias("b"))
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    tried = materialise(possible(hubs.unionByName(stars).distinct(), contents, percent))
    links = verified(docs, tried, contents, words, percent)
    first = components(links)

    parts = materialise(
        merged(members, first, "node", "left").select("node", "leader", F.coalesce("component", "node").alias("component"))
    )
    expanded = merged(lists.select("token", F.col("node").alias("leader"), "rare"), parts, "leader")
    within = parts.select(F.xxhash64(F.lit("group"), "leader").alias("token"), "leader", F.lit(False).alias("rare"), "node", "component")
    crowded = parts.groupBy("leader").agg(F.count("*").alias("m")).where("m > 1").select("leader")
    within = merged(within, crowded, "leader")
    open_lists = with_least(expanded.unionByName(within), "component", "component")
    # Lists of frequent shingles are few rows but many pairs: they get the long parity.
    sized = contents.select("node", "n", "parity", "fine")
    open_lists = merged(open_lists.select("token", "node", "component", "rare"), sized, "node")
    open_lists = open_lists.withColumn("parity", F.when(F.col("rare"), F.col("parity")).otherwise(F.col("fine")))
    open_lists = open_lists.drop("rare", "fine")
    rest = materialise(merged(across(open_lists, percent).distinct(), tried, ["a", "b"], "left_anti"))
    more = verified(docs, rest, contents, words, percent)
    final = components(links.unionByName(more))

    reps = nodes.select(F.col("node").alias("component"), F.col("rep").alias("lead"))
    named = merged(final, reps, "component").select("node", "lead")
    by_content = merged(nodes, named, "node", "left").select("h1", "h2", F.coalesce("lead", "rep").alias("lead"))
    out = merged(each.where("n > 0"), by_content, ["h1", "h2"]).select("key", "n", "lead")
    lone = each.where("n = 0").select("key", "n", F.col("key").alias("lead"))
    return out.unionByName(lone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("lead").alias("component_id")
    )
