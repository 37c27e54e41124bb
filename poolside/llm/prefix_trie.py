"""Prefix trie of conversations by Patricia construction (op11).

A conversation is rebuilt from the first turns of another one and its own later turns. Each distinct sequence of first
turns is a node; members, children, leaves, saved bytes and the conversations that end there are told for all nodes.

1. Turns are put in order by a range sort, which splits a conversation of any length. Tasks number what they have of a
   conversation, and what earlier tasks had is added: at most one conversation goes on from a task to the next, so
   that table has fewer rows than there are tasks, and is broadcast.
2. A turn is a 128-bit digest and a number of bytes from here on. Rebuilt conversations are cut into strands of
   ``BLOCK`` turns; a strand hangs from the key of all turns before it, so no row grows with a conversation. Equal
   strands are one, with a count, so copies of a conversation cost nothing further.
3. Strands are sorted, and dealt out by ranges. Only where neighbours part (branch), where conversations end, and at
   leaves is a point made, on a stack of the path at hand; sums run over these points. The turns between two points
   have the members, leaves and children's leaves of the lower one, and their saved bytes differ by the bytes of the
   turns between: sums of the edge's suffixes, taken when the edge is left.
4. A node that two ranges share lies on the path of a range's first or last strand, no deeper than it agrees with its
   neighbour's. Only these nodes come in parts. A range counts turns and children that began in it, so parts add up.
5. Where there is more than one layer of strands, each strand's end takes over what hangs from it; sums of layers are
   joined by doubling, in as many rounds as the number of layers has bits.
6. The hash of who ends at a node needs all ids in order: ranges of (node, id) are written as text in pieces, and a
   piece at a time is hashed.

Order of turns: by turn, null first; equal turns by role, then by the text's first 32 characters, then by digest.
Repeated rows are turns like any other. Rows whose conv_id is null belong to no conversation. ``%`` keeps the sign of
a negative id, as in SQL. Null roles and texts are empty; texts of any length are read whole. An empty table gives no
rows, not even a root. Columns of any other name are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolside.llm.common import record_batches, rows_of, staged

#: Turns of a strand; ids of a piece of text.
BLOCK, PIECE = 4096, 8192
EMPTY = hashlib.sha256(b"").hexdigest()
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: What is told of a point, and what of it is added up over ranges.
SUMS = ("n_convs", "ends", "n_children", "n_leaves", "passed", "distinct")
NODE = "root1 long, root2 long, k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, ends long, n_children long, n_leaves long, passed long, distinct long, shared boolean, asks boolean, point boolean"
NAMES = [x.split()[0] for x in NODE.split(", ")]
HANGING = ("x_children", "x_leaves", "x_passed", "x_distinct")
TYPES = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in NODE.split(", ")]


def numbered(batches):
    """Sorted turns with their number among those of the conversation in this task."""
    part, conv, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        convs = batch.column(0).to_numpy()
        index = np.arange(len(convs))
        starts = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]]) if len(convs) else np.zeros(0, int)
        local = index - np.repeat(starts, np.diff(np.r_[starts, len(convs)]))
        if len(convs):
            first = starts[1] if len(starts) > 1 else len(convs)
            if conv == convs[0]:
                local[:first] += at
            conv, at = convs[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(convs), part)), pa.array(local), batch.column(1), batch.column(2)], names=["c", "part", "i", "digest", "size"])


def ordered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns (c, i, digest, size) in order, and conversations (c, h, donor, n: turns, lent: turns taken from the donor)."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    turns = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), by.alias("role"), F.substring(said, 1, 32).alias("head"),
        F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")).alias("digest"), F.octet_length(said).cast("long").alias("size"),
    )
    first = F.col("turn").asc_nulls_first()
    sorted_ = turns.repartitionByRange("c", first).sortWithinPartitions("c", first, "role", "head", "digest").select("c", "digest", "size")
    rows = staged(sorted_.mapInArrow(numbered, "c long, part long, i long, digest string, size long"))
    shares = staged(rows.groupBy("c", "part").agg(F.count("*").alias("here")))
    over = Window.partitionBy("c")
    before = shares.select("c", "part", (F.sum("here").over(over.orderBy("part")) - F.col("here")).alias("before")).filter("before > 0")
    turns = rows.join(F.broadcast(before), ["c", "part"], "left").select("c", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "size")
    known = shares.groupBy("c").agg(F.sum("here").alias("n")).select("c", "n", (F.crc32(F.col("c").cast("string").cast("binary")) % 9).alias("h"), (F.col("c") - F.col("c") % 5).alias("donor"))
    convs = known.join(known.select(F.col("c").alias("donor"), F.col("n").alias("has")), "donor", "left")
    return turns, staged(convs.select("c", "h", "donor", "n", F.least("h", F.coalesce("has", F.lit(0))).cast("long").alias("lent")))


def mixed(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit words turned into others that depend on their place."""
    x = words + (at.astype(np.uint64) + np.uint64(1)) * GOLD
    x = (x ^ x >> np.uint64(30)) * MIX[0]
    x = (x ^ x >> np.uint64(27)) * MIX[1]
    return x ^ x >> np.uint64(31)


def path_keys(key: bytes, base: int) -> np.ndarray:
    """Row d: the exclusive or of the first d turns' mixed digests (two words)."""
    words = np.frombuffer(key, "<u8").reshape(-1, 2)
    at = np.arange(base, base + len(words))
    hashed = np.stack([mixed(words[:, 0], at), mixed(words[:, 1], at)], axis=1) if len(words) else np.zeros((0, 2), np.uint64)
    return np.bitwise_xor.accumulate(np.concatenate([np.zeros((1, 2), np.uint64), hashed]), axis=0)


def block_keys(batches, block):
    """Strands with the key of their own turns alone."""
    for c, b, length, key, sizes in rows_of(batches, "c", "b", "length", "key", "sizes"):
        yield (c, b, length, key, sizes, *path_keys(key, b * block)[-1].view(np.int64).tolist())


def strands_of(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Per rebuilt conversation and strand: c, b (its number), length, key, sizes, own key, root key, base (turns before) and last."""
    length = (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    own = turns.join(convs, "c").filter("i >= h").select("c", (F.col("lent") + F.col("i") - F.col("h")).alias("d"), "digest", "size", length)
    early = turns.filter("i < 8").withColumnRenamed("c", "donor")
    lent = early.join(convs, "donor").filter("i < h").select("c", F.col("i").alias("d"), "digest", "size", length)
    blocks = own.union(lent).groupBy("c", F.expr(f"d div {block}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("d", "digest", "size"))).alias("t"), F.max("length").alias("length"))
    key = F.unhex(F.array_join(F.transform("t", lambda x: x.digest), ""))
    blocks = blocks.select("c", "b", "length", key.alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes"))
    none = convs.filter(length == 0).select("c", F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("length"), F.unhex(F.lit("")).alias("key"), F.array().cast("array<long>").alias("sizes"))
    schema = "c long, b long, length long, key binary, sizes array<long>, own1 long, own2 long"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]
    keyed = staged(blocks.union(none).mapInArrow(lambda batches: record_batches(block_keys(batches, block), names, types), schema))
    # the key of all turns before a strand; conversations of one strand need no window
    early = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    rooted = keyed.filter(f"length > {block}").withColumns({f"root{k}": F.coalesce(F.bit_xor(f"own{k}").over(early), F.lit(0).cast("long")) for k in (1, 2)})
    single = keyed.filter(f"length <= {block}").withColumns({f"root{k}": F.lit(0).cast("long") for k in (1, 2)})
    return staged(rooted.unionByName(single).select("*", (F.col("b") * block).alias("base"), (F.col("length") <= (F.col("b") + 1) * block).alias("last")))


def agreeing(a: bytes, b: bytes) -> int:
    """Turns that two strands begin with in common."""
    if a == b:
        return len(a) // 16
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(apart[0]) if len(apart) else n) // 16


def agreements(batches):
    """Sorted ranges' first and last strands: (range, turns shared with the range before, with the one after)."""
    held = None
    for shard, low, high in rows_of(batches, "shard", "low", "high"):
        shared = -1
        if held is not None:
            same = (held[2]["root1"], held[2]["root2"]) == (low["root1"], low["root2"])
            shared = agreeing(held[2]["key"], low["key"]) if same else -1
            yield held[0], held[1], shared
        held = (shard, shared, high)
    if held is not None:
        yield held[0], held[1], -1


class Point:
    """A branch, end or leaf of the path at hand; sums are of what was left below it so far."""

    __slots__ = ("depth", "n", "least", "ends", "children", "leaves", "passed", "distinct", "first")

    def __init__(self, depth, first=False):
        self.depth, self.first, self.least = depth, first, None
        self.n = self.ends = self.children = self.leaves = self.passed = self.distinct = 0

    def joined(self, n, least):
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


class Walk:
    """The path at hand of sorted strands below one root; points that are left give rows.

    ``left``: the depth to which the first strand agrees with the range before, -1 if not even the root is shared.
    """

    def __init__(self, root, base, left, first):
        self.root, self.base, self.left = root, base, left
        self.keys, self.bytes, self.key = np.zeros((1, 2), np.uint64), np.zeros(1, np.int64), b""
        self.stack = [Point(0, first)]

    def leave(self, to: int, right: int = -1):
        """Leaves all points deeper than ``to``; ``right``: the depth to which the next range agrees with this path."""
        while self.stack[-1].depth > to:
            top = self.stack.pop()
            up = max(to, self.stack[-1].depth)
            began = self.left if top.first else -1
            if top.n == top.ends and top.depth > right:
                top.leaves = 1
            yield self.edge(up, top, began, right)
            if self.stack[-1].depth < up:
                self.stack.append(Point(up, top.first))
            parent = self.stack[-1]
            parent.joined(top.n, top.least)
            parent.children += up + 1 > began
            parent.leaves += top.leaves
            parent.passed += top.passed + top.n * int(self.bytes[top.depth] - self.bytes[up])
            parent.distinct += top.distinct + int(self.bytes[top.depth] - self.bytes[min(max(up, began), top.depth)])
            parent.first |= top.first

    def edge(self, up, top, began, right):
        """Columns of the nodes from below depth ``up`` to a point, that included; bytes below them are suffix sums of the edge."""
        d = np.arange(up + 1, top.depth + 1)
        end, to, before = d == top.depth, int(self.bytes[top.depth]), self.bytes[d - 1]
        keys, above = (self.keys[d] ^ self.root).view(np.int64), (self.keys[d - 1] ^ self.root).view(np.int64)
        owned = self.bytes[np.minimum(np.maximum(d - 1, began), top.depth)]
        shared = max(began, right)
        like = [np.full(len(d), x) for x in (*self.root.view(np.int64).tolist(), top.least, top.n, top.leaves)]
        return (
            like[0], like[1], keys[:, 0], keys[:, 1], above[:, 0], above[:, 1], d + self.base, like[2], like[3],
            np.where(end, top.ends, 0), np.where(end, top.children, d + 1 > began), like[4], top.passed + top.n * (to - before), top.distinct + to - owned,
            d <= shared, (d == up + 1) | (d - 1 <= shared), end,
        )

    def add(self, key, sizes, n, least, ends, hanging):
        """A strand, after ``leave`` to where it parts from the one before; ``hanging``: children, leaves, passed and distinct below its end, if known."""
        self.keys, self.key = path_keys(key, self.base), key
        self.bytes = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(sizes, np.int64))])
        if key:
            self.stack.append(Point(len(key) // 16, self.stack[0].first and self.stack[0].n == 0 and len(self.stack) == 1))
        top = self.stack[-1]
        top.joined(n, least)
        top.ends = ends
        if hanging[0] is not None:
            top.children, top.leaves, top.passed, top.distinct = hanging

    def close(self, right: int = -1):
        """Leaves all; the root, which has no turn of its own, last."""
        yield from self.leave(0, right)
        top, keys = self.stack[0], self.root.view(np.int64).tolist()
        shared = (top.first and self.left >= 0) or right >= 0
        values = (*keys, *keys, 0, 0, self.base, top.least, top.n, top.ends, top.children, top.leaves or int(top.n == top.ends and not shared), top.passed, top.distinct, shared, False, True)
        yield tuple(np.array([x]) for x in values)


def nodes_of(batches):
    """Columns of NODE for some nodes at a time, from sorted strands, range by range; also the roots of deeper layers."""
    walk, shard, right = None, None, -1
    for at, r1, r2, base, key, sizes, n, least, ends, left, to, *hanging in rows_of(
        batches, "shard", "root1", "root2", "base", "key", "sizes", "n_convs", "first", "ends", "left", "right", *HANGING
    ):
        root = np.array([r1, r2], np.int64).view(np.uint64)
        if walk is None or at != shard or (root != walk.root).any():
            if walk is not None:
                yield from walk.close(right if at != shard else -1)
            walk = Walk(root, base, left if at != shard else -1, at != shard)
        shared, shard, right = agreeing(walk.key, key), at, to
        yield from walk.leave(shared)
        walk.add(key, sizes, n, least, ends, hanging)
    if walk is not None:
        yield from walk.close(right)


def node_batches(batches):
    held, size = [], 0
    for rows in nodes_of(batches):
        held.append(rows)
        size += len(rows[0])
        if size >= 8192:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(x) for x in c])).cast(t) for c, t in zip(zip(*held), TYPES)], names=NAMES)


def layer_sums(found: DataFrame, parents: DataFrame) -> DataFrame:
    """Per root of a deeper layer (x1, x2), what hangs from it: children, and leaves and bytes with all layers below."""
    sums = ("x_leaves", "x_passed", "x_distinct")
    at = staged(found.join(parents, ["x1", "x2"], "left"))
    while not at.filter("up1 is not null").isEmpty():
        below = at.filter("up1 is not null").groupBy(F.col("up1").alias("x1"), F.col("up2").alias("x2")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        above = at.select(F.col("x1").alias("up1"), F.col("x2").alias("up2"), F.col("up1").alias("next1"), F.col("up2").alias("next2"))
        at = at.join(below, ["x1", "x2"], "left").join(above, ["up1", "up2"], "left")
        at = staged(at.select("x1", "x2", "x_children", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums], F.col("next1").alias("up1"), F.col("next2").alias("up2")))
    return at.select("x1", "x2", "x_children", *sums)


def ends_hash(batches):
    """Pieces of (node, ids as text), sorted by node and first id, to one hash a node."""
    node, running = None, None
    for k1, k2, text in rows_of(batches, "k1", "k2", "text"):
        if (k1, k2) != node:
            if node is not None:
                yield (*node, running.hexdigest())
            node, running = (k1, k2), hashlib.sha256()
        else:
            running.update(b",")
        running.update(text.encode())
    if node is not None:
        yield (*node, running.hexdigest())


def pieces(batches):
    """Sorted (node, id) to texts of up to ``PIECE`` ids."""
    node, held = None, []
    for k1, k2, c in rows_of(batches, "k1", "k2", "c"):
        if (k1, k2) != node or len(held) == PIECE:
            if held:
                yield (*node, held[0], ",".join(map(str, held)))
            node, held = (k1, k2), []
        held.append(c)
    if held:
        yield (*node, held[0], ",".join(map(str, held)))


def end_hashes(ended: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of rows (k1, k2, c)."""
    longs = [pa.int64()] * 3
    named = lambda rows, *names: record_batches(rows, names, [*longs[: len(names) - 1], pa.string()])
    text = staged(ended.repartitionByRange("k1", "k2", "c").sortWithinPartitions("k1", "k2", "c").mapInArrow(lambda b: named(pieces(b), "k1", "k2", "first", "text"), "k1 long, k2 long, first long, text string"))
    return text.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(lambda b: named(ends_hash(b), "k1", "k2", "ends_sha256"), "k1 long, k2 long, ends_sha256 string")


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = ordered_turns(df, conv, turn, role, text)
    blocks = strands_of(turns, convs, block)
    root = ["root1", "root2"]
    merged = blocks.groupBy(*root, "base", "key").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n_convs"), F.min("c").alias("first"), F.count_if("last").alias("ends"))
    strands = staged(merged.repartitionByRange(*root, "key").select("*", F.spark_partition_id().alias("shard")))
    edges = strands.groupBy("shard").agg(*[f(F.struct(*root, "key")).alias(a) for f, a in ((F.min, "low"), (F.max, "high"))])
    longs = [pa.int64()] * 3
    bounds = edges.repartition(1).sortWithinPartitions("shard").mapInArrow(lambda b: record_batches(agreements(b), ["shard", "left", "right"], longs), "shard long, left long, right long")
    bounded = strands.join(F.broadcast(staged(bounds)), "shard")  # one row for each range
    def walked(rows):
        return staged(rows.repartition("shard").sortWithinPartitions("shard", *root, "key").mapInArrow(node_batches, NODE))

    plain = bounded.select("*", *[F.lit(None).cast("long").alias(c) for c in HANGING])
    deep = not blocks.filter("b > 0").isEmpty()
    found = walked(plain)
    if deep:
        below = found.filter("depth > 0 and k1 = root1 and k2 = root2").groupBy(F.col("k1").alias("x1"), F.col("k2").alias("x2"))
        below = below.agg(*[F.sum(c).alias(f"x_{c.removeprefix('n_')}") for c in ("n_children", "n_leaves", "passed", "distinct")])
        up = blocks.filter("not last").select((F.col("root1").bitwiseXOR(F.col("own1"))).alias("x1"), (F.col("root2").bitwiseXOR(F.col("own2"))).alias("x2"), F.col("root1").alias("up1"), F.col("root2").alias("up2"), "base")
        parents = up.filter("base > 0").select("x1", "x2", "up1", "up2").distinct()
        hanging = layer_sums(below, parents)
        ends = blocks.filter("not last").select(*root, "base", "key", F.col("root1").bitwiseXOR(F.col("own1")).alias("x1"), F.col("root2").bitwiseXOR(F.col("own2")).alias("x2")).distinct()
        found = walked(bounded.join(ends.join(hanging, ["x1", "x2"]).drop("x1", "x2"), [*root, "base", "key"], "left"))
        found = found.filter("depth = 0 or k1 != root1 or k2 != root2")
    shared = found.filter("shared").groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in ("p1", "p2", "depth")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS], (F.first("depth") > 0).alias("asks"), F.lit(True).alias("point")
    )
    columns = ["k1", "k2", "p1", "p2", "depth", "conv_id", *SUMS, "asks", "point"]
    nodes = staged(found.filter("not shared").select(*columns).union(shared.select(*columns)))
    points = nodes.filter("point").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    asked = nodes.filter("asks").join(points, ["p1", "p2"])
    others = nodes.filter("not asks").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    full = asked.unionByName(others)
    ended = blocks.filter("last").select((F.col("root1").bitwiseXOR(F.col("own1"))).alias("k1"), (F.col("root2").bitwiseXOR(F.col("own2"))).alias("k2"), "c")
    hashed = full.filter("ends > 0").join(end_hashes(ended), ["k1", "k2"])
    silent = full.filter("ends = 0").withColumn("ends_sha256", F.lit(EMPTY))
    return hashed.unionByName(silent).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("passed") - F.col("distinct")).alias("saved_tokens"), "ends_sha256"
    )
