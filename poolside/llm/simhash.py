"""SimHash near-duplicate classes by a binary-trie self-join (op4).

A fingerprint has a bit for each bit of a 64-bit hash, set where over half of a text's shingle hashes have
it. Fingerprints of at most ``max_bits`` different bits are linked, and a class is what links connect.

1. One pass makes the fingerprints; equal ones become one node, named by its smallest id.
2. If the bits are cut into ``max_bits + 1`` segments, linked fingerprints agree on at least one. So each
   node goes to one bucket per segment, named by so many of the segment's bits that buckets have about
   ``BUCKET`` nodes, and buckets are joined apart from each other. With more nodes, the bits are cut into more
   segments and buckets are named by several of them, so buckets don't grow.
3. A bucket of more than ``CHUNK`` nodes is dealt out in chunks, and each pair of chunks is a task of its own.
4. Within a task, sorted fingerprints are a binary trie. Pairs of its nodes are traversed together and the
   differing bits above them summed; a pair over the budget is left. Links become a spanning forest there,
   so a group of n near copies gives n - 1 edges and not n * n.
5. Edges become stars of their smallest node, by alternating star contraction over written tables.

``one_of_each`` keeps one row of each class. Its fingerprints are those of a text's distinct words, which near
copies share more of than of their shingles, and links need sketches, too, that say that the sets of five-word
shingles are alike. Its buckets are named by two segments or more, so what is shuffled grows in proportion but for
a few steps.

Null and empty texts have fingerprint zero and are linked like any other. Rows whose id is null get a
fingerprint, and the class of their fingerprint; a class without any id is null. Repeated rows stay.
A text of any length is read whole. An empty table gives no rows; only the two named columns are read for classes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.llm.common import free_name, rows_of, staged, text_rows

#: Nodes of a bucket that are joined in one task; larger buckets are dealt out in chunks of about so many.
CHUNK = 4096
#: Nodes of a bucket, about; groups of segments that name buckets, at most.
BUCKET, GROUPS = 512, 72
#: Of at most so many buckets that can be, the large ones' sizes are broadcast (20 bytes each).
NAMES = 1 << 20
#: Pairs of trie nodes with at most so many leaf pairs are compared leaf by leaf; pairs of fingerprints in one block.
LEAF_PAIRS, BLOCK = 4096, 1 << 17
#: Numbers of 64 bits of a sketch: each bit is that of the least shingle hash of one permutation.
SKETCH = 4
SKETCHED = tuple(f"s{k}" for k in range(SKETCH))


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text; A-Z are lower-cased, and a text of fewer words is one shingle."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    data = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: len(tokens) - min(words, len(tokens))].tolist()]
    stops = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):
        hashes = np.array([digest(data[i:j], seed) for i, j in zip(starts[at : at + 65536], stops[at : at + 65536])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands that permute 64-bit numbers."""
    rng = np.random.default_rng(11)
    return rng.integers(0, 2**63, 64 * SKETCH, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 2**63, 64 * SKETCH, np.uint64)


def sketch(text: str, words: int = 5) -> list[int]:
    """Sketch of the set of a text's shingles: two texts' bits agree with probability (1 + Jaccard similarity) / 2."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh3_64_intdigest
    shingles = {digest(b" ".join(tokens[i : i + words])) for i in range(max(1, len(tokens) - words + 1))}
    hashes, (factors, summands) = np.fromiter(shingles, np.uint64, len(shingles)), permutations()
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        x = hashes[at : at + 1024, None] * factors + summands
        least = np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=0))
    bits = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 4) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""
    return with_prints(text_rows(df, id_col, text_col), ("id",), words)


def word_fingerprint(text: str, seed: int = 42) -> int:
    """The fingerprint of a text's distinct words; A-Z are lower-cased."""
    distinct = set(text.encode("utf-8", "surrogatepass").lower().split())
    if not distinct:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct), "<u8", len(distinct))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_prints(rows: DataFrame, names: tuple[str, ...], words: int | None, sketched: bool = False) -> DataFrame:
    """The columns ``names`` (longs) of rows with a text, and fp (of distinct words if ``words`` is None); with their sketch if asked for."""
    more = SKETCHED if sketched else ()

    def make(batches):
        held = []
        for *values, text in rows_of(batches, *names, "text"):
            fp = word_fingerprint(text) if words is None else fingerprint(text, words)
            held.append((*values, fp - (1 << 64) if fp >> 63 else fp, *(sketch(text) if sketched else ())))
            if len(held) == 8192:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=[*names, "fp", *more])

    return rows.mapInArrow(make, ", ".join(f"{c} long" for c in (*names, "fp", *more)))


def trie_links(left: np.ndarray, right: np.ndarray | None, max_bits: int):
    """Blocks (rows of left, rows of right) of linked fingerprints; both sides sorted, ``right`` None for a self-join."""
    own = right is None
    right = left if own else right
    stack = [(0, len(left), 0, len(right), 64, 0)]
    while stack:
        a, b, c, d, bits, spent = stack.pop()
        if a == b or c == d:
            continue
        first, mask = int(left[a]), (1 << bits) - 1
        apart = (first ^ int(right[c])) & mask
        spread = ((first ^ int(left[b - 1])) | (int(right[c]) ^ int(right[d - 1]))) & mask
        fork = spread.bit_length()
        spent += (apart >> fork).bit_count()
        if spent > max_bits:
            continue
        if (b - a) * (d - c) <= LEAF_PAIRS or not fork:
            step = max(1, BLOCK // (d - c))
            for at in range(a, b, step):
                rows, columns = np.nonzero(np.bitwise_count(left[at : min(b, at + step), None] ^ right[None, c:d]) <= max_bits)
                yield rows + at, columns + c
            continue
        half = 1 << fork - 1
        m = a + int(np.searchsorted(left[a:b] & np.uint64(2 * half - 1), half))
        n = c + int(np.searchsorted(right[c:d] & np.uint64(2 * half - 1), half))
        stack += [(a, m, c, n, fork - 1, spent), (m, b, n, d, fork - 1, spent)]
        if spent < max_bits:
            stack.append((a, m, n, d, fork - 1, spent + 1))
            if not (own and (a, b) == (c, d)):
                stack.append((m, b, c, n, fork - 1, spent + 1))


def forest(prints: np.ndarray, side: np.ndarray, max_bits: int, sketches: np.ndarray | None = None, apart_most: int = 0) -> np.ndarray:
    """For each of the fingerprints, the first of its class here. ``side``: 0 and 1 are joined with each other, or all are 0.

    With ``sketches`` (rows of SKETCH numbers), links have at most ``apart_most`` different bits in them, too.
    """
    order = np.lexsort((prints, side))
    cut = int(np.searchsorted(side[order], 1))
    left, right = prints[order[:cut]], prints[order[cut:]]
    label = np.arange(len(prints))
    for rows, columns in trie_links(left, right if len(right) else None, max_bits):
        a, b = order[rows], order[columns + (cut if len(right) else 0)]
        if sketches is not None:
            known = label[a] == label[b]
            a, b = a[~known], b[~known]
            alike = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1) <= apart_most
            a, b = a[alike], b[alike]
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            to = np.arange(len(label))
            np.minimum.at(to, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    return label


def segments(n_nodes: int, max_bits: int, alike: bool = False) -> list[tuple[int, ...]]:
    """Groups of bits so that linked fingerprints agree on at least one group.

    With s segments, s - max_bits are untouched by any link, so buckets are named by bits of that many. More nodes
    take more segments, till there would be over ``GROUPS`` groups; few nodes take fewer bits of a segment.
    ``alike``: two segments name a bucket until there are ``CHUNK`` nodes for each name, then one more, and so on, so
    that a bucket is a chunk on average at any size and what is sent grows by steps of a few times for thousands of
    times the nodes (7 bits: 36 groups to 67 million nodes, 120 to two billion, 330 to 34 billion).
    """
    s = max_bits + (2 if alike else 1)
    wanted = 64 if alike else max(0, n_nodes // BUCKET).bit_length()
    while alike and n_nodes > CHUNK << 64 * (s - max_bits) // s:
        s += 1
    while not alike and 64 * (s - max_bits) // s < wanted and comb(s + 1, max_bits) <= GROUPS:
        s += 1
    edges = [round(64 * i / s) for i in range(s + 1)]
    groups = (tuple(bit for i in chosen for bit in range(edges[i], edges[i + 1]))[:wanted] for chosen in combinations(range(s), s - max_bits))
    return list(dict.fromkeys(groups))


def links(nodes: DataFrame, max_bits: int, apart_most: int | None = None) -> DataFrame:
    """Edges (u > v) that connect the linked ones of ``nodes`` (node, fp; with ``apart_most``, also the sketch)."""
    more = [] if apart_most is None else list(SKETCHED)
    groups = segments(nodes.count(), max_bits, alike=bool(more))
    masks = [sum(1 << b for b in bits) for bits in groups]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("node", "fp", *more, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("part", "value"))
    sizes = keyed.groupBy("part", "value").agg(F.count("*").alias("size"))
    parts = F.ceil(F.coalesce("size", F.lit(1)) / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    if sum(1 << len(bits) for bits in groups) <= NAMES:
        sized = keyed.join(F.broadcast(sizes.filter(F.col("size") > CHUNK)), ["part", "value"], "left")
    else:
        sized = keyed.join(sizes.filter("size > 1"), ["part", "value"])
    pairs = (
        sized.select("node", "fp", *more, "part", "value", parts.alias("parts"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", "fp", *more, "part", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    key = ["part", "value", "low", "high"]
    return pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: bucket_edges(batches, key, max_bits, apart_most), "u long, v long")


def bucket_edges(batches, key, max_bits, apart_most):
    """Edges of sorted rows, a bucket at a time; only the bucket at hand is held."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        columns = [part.column(k).to_numpy() for k in key]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if len(part) > 1 else np.array([], int)
        last = int(new[-1]) if len(new) else 0
        rest = part.slice(last)
        yield from edges_of(part.slice(0, last), [0, *new.tolist()], max_bits, apart_most)
    if rest is not None and len(rest):
        yield from edges_of(rest, [0, len(rest)], max_bits, apart_most)


def edges_of(part, bounds, max_bits, apart_most):
    if not len(part):
        return
    node, prints, side = (part.column(c).to_numpy() for c in ("node", "fp", "side"))
    prints = prints.view(np.uint64)
    sketches = None if apart_most is None else np.stack([part.column(c).to_numpy() for c in SKETCHED], axis=1).view(np.uint64)
    found = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a < 2:
            continue
        order = np.argsort(node[a:b], kind="stable") + a
        first = order[forest(prints[order], side[order], max_bits, None if sketches is None else sketches[order], apart_most)]
        linked = first != order
        found.append((node[order[linked]], node[first[linked]]))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["u", "v"])


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots; the root is the smallest node that edges (u > v) connect.

    Alternates between linking a node's larger neighbours to its smallest one, and its smaller neighbours to
    the smallest; ends when a round changes nothing. Minima are summed up before the shuffle, and written
    so that a join with a hub's rows can be split.
    """
    at = staged(edges.distinct())
    state = None
    while True:
        both = at.select("u", "v").union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """Per row: ``id_col``, fingerprint (16 hexadecimal digits), component_id (smallest id of the class)."""
    rows = staged(fingerprints(df, id_col, text_col, words))
    by_print = staged(rows.groupBy("fp").agg(F.min("id").alias("node")))
    nodes = by_print.filter("node is not null")
    roots = stars(links(nodes, max_bits))
    classes = by_print.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, max_bits: int = 7, similarity: float | None = 0.8) -> DataFrame:
    """One row of ``df`` for each class: that of the smallest id, then text hash, then row number. Rows whose id is null can't be compared and stay.

    Links have at most ``max_bits`` different bits in fingerprints of distinct words (of ``words``-word shingles where
    given). With ``similarity`` they have sketches of five-word shingles, too, that can be those of sets so alike; a
    standard deviation and a half is allowed for.
    Rows are told apart by a written number and not by their ids, so different texts with one id are judged each
    for itself, and what is computed again after a loss chooses the same rows. Columns of any name stay as they are.
    """
    number = free_name(df, "_row")
    more, apart_most = (), None
    if similarity is not None:
        bits, apart = 64 * SKETCH, (1 - similarity) / 2
        more, apart_most = SKETCHED, round(bits * apart + 1.5 * (bits * apart * (1 - apart)) ** 0.5)
    numbered = staged(df.withColumn(number, F.monotonically_increasing_id()))
    texts = numbered.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    rows = staged(with_prints(texts.withColumn("hash", F.xxhash64("text")), ("row", "id", "hash"), words, sketched=bool(more)))
    by_print = staged(rows.groupBy("fp", *more).agg(F.min("row").alias("node"), F.min(F.struct("id", "hash", "row")).alias("first")))
    roots = stars(links(by_print.select("node", "fp", *more), max_bits, apart_most))
    first = by_print.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    keep = staged(first.select(F.col("first.row").alias(number)))
    # what is kept grows with the input, so it isn't broadcast at any size
    return numbered.join(keep.hint("merge"), number, "left_semi").select(*df.columns).union(numbered.filter(F.col(id_col).isNull()).select(*df.columns))
