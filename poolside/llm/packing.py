"""Best-fit packing of documents into sequences by a grouping genetic algorithm (op7).

A document is its token ids and an end id. Where a text spells one of the tokenizer file's added tokens, it has
that token's id; the parts between are encoded each for itself. Documents of over ``capacity`` ids are cut into pieces of
``capacity``, the first piece of what is left over; others are one piece. Full pieces fill a sequence.

The rest is dealt into shares of about ``SHARE`` pieces by a hash, and a share's packings evolve on islands
(tasks of their own). Crossover injects well-filled bins of one parent whole into the other, removes the bins
that would hold a piece twice, and lets displaced pieces take the place of smaller ones where that fills a bin
better, then puts the rest where they fit best; mutation empties the least filled bins. After each epoch an island's elite goes to the next one. A share that needs no more bins than
its total length asks for stops at once. Badly filled bins of all shares are then packed again together, in
ever fewer shares.

Null and empty texts are one piece, of the end id. Rows whose id is null or repeats are packed like others.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.llm.common import record_batches, rows_of, staged, text_rows

#: Pieces of a share; islands a share evolves on; epochs between migrations; generations of an epoch.
SHARE, ISLANDS, EPOCHS, GENERATIONS = 4096, 2, 2, 12
#: A bin filled less goes on to the next level.
FILLED = 0.97


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that are printable as themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def encoding_of(path: str, pattern: str):
    """The tokenizer of a ``tokenizers`` byte-level BPE file, run by tiktoken, which gives the same ids several times faster.

    It is for the text between added tokens: by itself it takes them for ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    merged = {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]}
    of = byte_of_char()
    special = {t["content"] for t in model.get("added_tokens", [])} - merged - of.keys()
    ranks = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: A longer run of white space would overflow the stack of tiktoken's own splitting.
RUN = regex.compile(r"\s{500}")


def ids_of(encoding, pattern, text: str) -> list[int]:
    if RUN.search(text):
        return [i for piece in pattern.findall(text) for i in encoding._encode_single_piece(piece)]
    return encoding.encode_ordinary(text)


#: White space and the characters of words, as ``tokenizers`` has them.
SPACE, WORD = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"
SPACES, AFTER_WORD, BEFORE_WORD = regex.compile(f"{SPACE}*"), regex.compile(f"(?<={WORD})"), regex.compile(WORD)


@lru_cache(maxsize=1)
def added_of(path: str) -> list[tuple]:
    """What finds a file's added tokens, and (id, flags) of each: those found in the text itself first, then those of normalised text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocabulary, steps = model["model"]["vocab"], []
    for normalised in (False, True):
        tokens = {t["content"]: (vocabulary.get(t["content"], t["id"]), t) for t in model.get("added_tokens", []) if t["content"] and t.get("normalized", False) == normalised}
        if tokens:
            steps.append((re.compile("|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True))), tokens))
    return steps


def at_added(finder, tokens: dict, text: str):
    """The parts of a text: an added token's id, or text between. The longest token counts, and takes the white space that its flags say."""
    begin = 0
    for found in finder.finditer(text):
        (start, stop), (token, flags) = found.span(), tokens[found.group()]
        if flags.get("single_word") and (AFTER_WORD.match(text, start) or BEFORE_WORD.match(text, stop)):
            continue
        if flags.get("lstrip"):
            while start > begin and SPACES.match(text, start - 1).end() > start - 1:
                start -= 1
        if flags.get("rstrip"):
            stop = SPACES.match(text, stop).end()
        if begin < start:
            yield text[begin:start]
        yield token
        begin = stop
    if begin < len(text):
        yield text[begin:]


def all_ids(encoding, pattern, added: list[tuple], text: str) -> list[int]:
    """The ids of a text, added tokens' own ones included."""
    parts = [text]
    for finder, tokens in added:
        parts = [x for p in parts for x in (at_added(finder, tokens, p) if isinstance(p, str) else [p])]
    return [i for p in parts for i in (ids_of(encoding, pattern, p) if isinstance(p, str) else [p])]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(df: DataFrame, tokenizer: str, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """key (a number for each piece), id, piece, start, length, crc."""

    def tokenise(batches):
        encoding, split, key = encoding_of(tokenizer, pattern), regex.compile(pattern), TaskContext.get().partitionId() << 40
        added = added_of(tokenizer)
        for doc, text in rows_of(batches, "id", "text"):
            ids = np.array([*all_ids(encoding, split, added, text), end_id], "<u4")
            for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                yield key, doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())
                key += 1

    names = ("key", "id", "piece", "start", "length", "crc")
    schema = "key long, id long, piece int, start long, length long, crc long"
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return text_rows(df, id_col, text_col).mapInArrow(lambda b: record_batches(tokenise(b), names, types), schema)


class Packing:
    """Bins of piece numbers, and how full they are."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins or []
        self.fill = [sum(map(lengths.__getitem__, b)) for b in self.bins]

    def put(self, items) -> Packing:
        """Each item, the longest first, into the bin that it fills best, or a new one."""
        lengths, capacity = self.lengths, self.capacity
        by_room: dict[int, list[int]] = {}
        mask = 0  # bit r: a bin has room r
        for k, f in enumerate(self.fill):
            by_room.setdefault(capacity - f, []).append(k)
            mask |= 1 << capacity - f
        for i in sorted(items, key=lengths.__getitem__, reverse=True):
            n = lengths[i]
            fitting = mask >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
            else:
                room, k = capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[k].append(i)
            self.fill[k] += n
            by_room.setdefault(room - n, []).append(k)
            mask |= 1 << room - n
        return self

    def refilled(self, displaced: list[int], rng: random.Random) -> Packing:
        """Displaced pieces take the place of smaller pieces, or pairs, where that fills a bin better; what is left then goes where it fits best."""
        lengths, capacity = self.lengths, self.capacity
        out = sorted((lengths[i], i) for i in displaced)
        for k in rng.sample(range(len(self.bins)), len(self.bins)):
            b, room = self.bins[k], capacity - self.fill[k]
            if not room or not out:
                continue
            best = (0, (), ())
            leaving = [(lengths[i], (i,)) for i in b]
            if len(b) <= 12:
                leaving += [(lengths[b[x]] + lengths[b[y]], (b[x], b[y])) for x in range(len(b)) for y in range(x)]
            for gone, items in leaving:
                free = gone + room
                at = bisect(out, (free, 1 << 62)) - 1
                if at >= 0 and out[at][0] - gone > best[0]:
                    best = (out[at][0] - gone, items, (at,))
                if best[0] < room and len(items) == 2 and len(out) > 1:
                    # two for two
                    low, high = 0, len(out) - 1
                    while low < high:
                        both = out[low][0] + out[high][0]
                        if both > free:
                            high -= 1
                        else:
                            if both - gone > best[0]:
                                best = (both - gone, items, (low, high))
                            low += 1
                if best[0] == room:
                    break
            if best[0]:
                _, items, places = best
                b[:] = [i for i in b if i not in items] + [out[at][1] for at in places]
                for at in sorted(places, reverse=True):
                    del out[at]
                for i in items:
                    insort(out, (lengths[i], i))
                self.fill[k] += best[0]
        return self.put(i for _, i in out)

    def cost(self) -> tuple[int, float]:
        """Fewer bins are better, then fuller ones beside emptier ones."""
        return len(self.bins), -sum(f * f for f in self.fill)

    def crossed(self, other: Packing, rng: random.Random) -> Packing:
        """This packing with some of the best bins of the other."""
        best = sorted(range(len(other.bins)), key=other.fill.__getitem__, reverse=True)[: max(1, len(other.bins) // 3)]
        injected = [other.bins[k] for k in best if rng.random() < 0.5]
        inside = {i for b in injected for i in b}
        kept = [b for b in self.bins if inside.isdisjoint(b)]
        displaced = [i for b in self.bins if not inside.isdisjoint(b) for i in b if i not in inside]
        return Packing(self.lengths, self.capacity, [list(b) for b in kept + injected]).refilled(displaced, rng)

    def mutated(self, rng: random.Random) -> Packing:
        """This packing with its least filled bins and a few others emptied and dealt again."""
        order = sorted(range(len(self.bins)), key=self.fill.__getitem__)
        out = {*order[: max(1, len(order) // 50)], *(rng.randrange(len(order)) for _ in range(max(1, len(order) // 20)))}
        return Packing(self.lengths, self.capacity, [list(b) for k, b in enumerate(self.bins) if k not in out]).refilled([i for k in out for i in self.bins[k]], rng)


def evolve(lengths: list[int], capacity: int, seeds: list[list[list[int]]], seed: int, generations: int = GENERATIONS, size: int = 4) -> Packing:
    """The best packing of some generations; starts from ``seeds`` (bins of item numbers), best fit, and random orders."""
    rng, least = random.Random(seed), -(-sum(lengths) // capacity)
    population = [Packing(lengths, capacity, [list(b) for b in bins]) for bins in seeds] or [Packing(lengths, capacity).put(range(len(lengths)))]
    if min(p.cost() for p in population)[0] > least:
        while len(population) < size:
            population.append(population[0].mutated(rng))
        for _ in range(generations):
            population.sort(key=Packing.cost)
            if len(population[0].bins) == least:
                break
            a, b = rng.sample(population, 2)
            population = [*population[: size - 1], min((a.crossed(b, rng), b.crossed(a, rng), population[0].mutated(rng)), key=Packing.cost)]
    return min(population, key=Packing.cost)


def bins_of(group: list[int]) -> list[list[int]]:
    """Bins from each item's bin number."""
    found: dict[int, list[int]] = {}
    for i, k in enumerate(group):
        found.setdefault(k, []).append(i)
    return list(found.values())


def evolved(shares: DataFrame, capacity: int) -> DataFrame:
    """share, keys, lengths and bin numbers (``group``) of each share's best packing."""

    def epoch(batches):
        for share, island, keys, lengths, elites in rows_of(batches, "share", "island", "keys", "lengths", "elites"):
            best = evolve(lengths, capacity, [bins_of(e) for e in elites], 1000 * island + len(keys))
            group = [0] * len(keys)
            for k, b in enumerate(best.bins):
                for i in b:
                    group[i] = k
            yield share, island, keys, lengths, len(best.bins), group

    lists = pa.list_(pa.int64())
    names, types = ("share", "island", "keys", "lengths", "n_bins", "group"), (pa.int64(), pa.int32(), lists, lists, pa.int64(), lists)
    schema = "share long, island int, keys array<long>, lengths array<long>, n_bins long, group array<long>"
    run = lambda at: staged(at.mapInArrow(lambda b: record_batches(epoch(b), names, types, 16), schema))
    at = run(shares.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("elites", F.array().cast("array<array<bigint>>")).repartition("share", "island"))
    for _ in range(EPOCHS - 1):
        # each island keeps its own elite and gets its neighbour's
        came = at.select("share", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("group").alias("elite"))
        at = run(at.join(came, ["share", "island"]).select("share", "island", "keys", "lengths", F.array("group", "elite").alias("elites")))
    return at.groupBy("share").agg(F.min_by(F.struct("keys", "lengths", "group"), F.struct("n_bins", "island")).alias("best")).select("share", "best.*")


def packed(items: DataFrame, capacity: int) -> DataFrame:
    """key, bin (the least key in it) and place (the offset there) for items (key, length)."""
    done, left, n = [], items, items.count()
    while True:
        shares = max(1, round(n / SHARE))
        share = F.pmod(F.xxhash64("key", F.lit(shares)), F.lit(shares)).alias("share")
        dealt = left.select("key", "length", share).groupBy("share").agg(F.array_sort(F.collect_list(F.struct("key", "length"))).alias("items"))
        best = evolved(dealt.select("share", F.col("items.key").alias("keys"), F.col("items.length").alias("lengths")), capacity)
        placed = staged(best.mapInArrow(places, "key long, length long, bin long, place long, filled long"))
        if shares == 1:
            return union([*done, placed.select("key", "bin", "place")])
        badly = placed.filter(F.col("filled") < FILLED * capacity)
        m = badly.count()
        # of what is packed again, ever less can be gained
        if m > 0.7 * n or not m:
            return union([*done, placed.select("key", "bin", "place")])
        done.append(placed.filter(F.col("filled") >= FILLED * capacity).select("key", "bin", "place"))
        left, n = badly.select("key", "length"), m


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def places(batches):
    def rows():
        for keys, lengths, group in rows_of(batches, "keys", "lengths", "group"):
            for b in bins_of(group):
                filled, place = sum(lengths[i] for i in b), 0
                for i in b:
                    yield keys[i], lengths[i], keys[b[0]], place, filled
                    place += lengths[i]

    yield from record_batches(rows(), ("key", "length", "bin", "place", "filled"), (pa.int64(),) * 5)


def pack(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset."""
    items = staged(pieces(df, tokenizer, pattern, id_col, text_col, capacity, end_id))
    full = items.filter(F.col("length") == capacity).withColumn("bin", F.col("key")).withColumn("place", F.lit(0).cast("long"))
    rest = items.filter(F.col("length") < capacity)
    rest = rest.join(packed(rest.select("key", "length"), capacity), "key")
    names = (id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return full.unionByName(rest).select(*(F.col(c).alias(n) for c, n in zip(("id", "piece", "start", "length", "crc", "bin", "place"), names)))
