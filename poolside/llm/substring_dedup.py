"""Removal of passages that an earlier document has, by repeated-phrase automata (op10).

A window is ``width`` consecutive words of one document. A word goes if it is covered by a window whose word
sequence also starts in a document of a smaller id; windows are judged on the input, not on what is left.

1. Sketch: one pass hashes words. Each window's anchor is the least of the hashes of its shingles, so equal
   windows have equal anchors, and a text has few of them. Texts whose words are all equal are one class, and
   only the class's smallest id goes on: the others lose every word that a window covers.
2. Anchors of two classes or more recur; each names a cell (the smallest id that has it).
3. Confirm: windows whose anchor recurs are grouped by a 128-bit hash. Those in several documents are
   confirmed, with the first document and place. Runs of them in first documents are recurring passages.
4. Locate: a passage and the documents' regions around its anchors meet in the anchors' cells. A shard is a
   slice of a cell's passages with a slice of its regions, so no shard grows with a frequent passage. In each,
   an Aho-Corasick automaton over words has a phrase of every passage per ``width - phrase + 1`` words (so each
   window holds one in full); regions stream through it. Windows around hits are looked up among the passages'
   windows and compared with them by 64-bit hashes of their words, one by one. What they cover is removed.

Null texts and texts of fewer words lose nothing. Rows whose id is null are kept whole and judge no other.
Rows that repeat an id are judged each by itself, and never against each other. Texts of any length are read
whole; of equal texts the smallest id keeps its words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.llm.common import WORD, dropped, free_name, record_batches, rows_of, staged, text_rows

#: Words of the shingles that anchors are taken from, and of the phrases in automata.
SHINGLE, PHRASE = 18, 8
#: Phrases of one automaton and words of the regions that stream through it, about.
SHARD_PHRASES, SHARD_WORDS = 100_000, 1_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            digest = xxhash.xxh3_64_intdigest
            for i, h in enumerate(found):
                if h is None:
                    found[i] = known[words[i]] = digest(words[i])
        return np.array(found, np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, width: int, base: int = BASE, inverse: int = INVERSE) -> np.ndarray:
    """The hash of each ``width`` consecutive words."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, n), dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * powers(inverse, n - width + 1))


def window_keys(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window, in two halves."""
    other = 0xA24BAED4963EE407
    return rolling(hashes, width), rolling(mixed(hashes + np.uint64(1)), width, other, pow(other, -1, 1 << 64))


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Each window's anchor: the least hash of its shingles."""
    least, span, done = rolling(hashes, min(SHINGLE, width)), width - min(SHINGLE, width) + 1, 1
    while done < span and len(least):
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        done += step
    return least


def runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    return np.cumsum(edges)[:n] > 0


def sketches(df: DataFrame, width: int) -> DataFrame:
    """row (a number for each row), id, n_words, whole (sha256 of the joined words), found (its windows' distinct anchors)."""

    def sketch(batches):
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 40
        for doc, text in rows_of(batches, "id", "text"):
            words = words_of(text)
            whole = hashlib.sha256(b" ".join(words)).digest()
            found = np.unique(anchors(hashes(words), width)) if doc is not None else []
            yield row, doc, len(words), whole, [int(x) for x in np.array(found, np.uint64).view(np.int64)], text
            row += 1

    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.string())
    names = ("row", "id", "n_words", "whole", "found", "text")
    return df.mapInArrow(lambda b: record_batches(sketch(b), names, types, 1024), "row long, id long, n_words long, whole binary, found array<long>, text string")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> tuple[DataFrame, DataFrame]:
    """What each row loses, as two written tables.

    decisions (row, id, n_words, whole, twin, judge: the row whose spans hold for this one too); hit (row, text,
    spans) for the judges that lose words. Tables between go as soon as the next one is written.
    """
    if width < PHRASE:
        raise ValueError(f"windows have {PHRASE} words at least")
    rows = staged(sketches(text_rows(df, id_col, text_col), width))
    long = rows.filter((F.col("n_words") >= width) & F.col("id").isNotNull())
    classes = long.groupBy("whole").agg(F.min(F.struct("id", "row")).alias("first")).select("whole", F.col("first.id").alias("earliest"), F.col("first.row").alias("judge"))
    decisions = staged(rows.select("row", "id", "n_words", "whole", "found").join(classes, "whole", "left"))
    each = staged(decisions.filter("row = judge").select("row", "id", F.explode("found").alias("anchor")))
    recurring = each.groupBy("anchor").agg(F.min("id").alias("cell"), F.max("id").alias("last")).filter("cell < last").select("anchor", "cell")
    by_row = staged(each.join(recurring, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "cell")).alias("cells")))
    dropped(each)
    suspects = staged(rows.select("row", "id", "text").join(by_row, "row"))
    dropped(rows, by_row)
    parts = staged(cell_parts(suspects.join(confirmed_passages(suspects, width), "row", "left"), width))
    spans = located(parts, width).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    hit = staged(suspects.select("row", "text").join(spans, "row"))
    dropped(suspects, parts)
    twin = F.coalesce(F.col("id").isNotNull() & (F.col("id") > F.col("earliest")), F.lit(False))
    return decisions.select("row", "id", "n_words", "whole", twin.alias("twin"), F.when(~twin & F.col("id").isNotNull(), F.col("judge")).alias("judge")), hit


def left_of(hit: DataFrame) -> DataFrame:
    """judge, n_left, kept: the words that stay, joined by a space."""

    def cut(batches):
        for row, text, spans in rows_of(batches, "row", "text", "spans"):
            words = words_of(text)
            left = [words[i] for i in np.flatnonzero(~covered([(s["start"], s["end"]) for s in spans], len(words)))]
            yield row, len(left), b" ".join(left).decode("utf-8", "surrogatepass")

    names, types = ("judge", "n_left", "kept"), (pa.int64(), pa.int64(), pa.string())
    return hit.mapInArrow(lambda b: record_batches(cut(b), names, types), "judge long, n_left long, kept string")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, changed: str | None = None) -> DataFrame:
    """The rows of ``df`` with their texts cut: a text that loses nothing stays as it is, else its words are joined by a space.

    Texts that lose all their words become empty. Columns of any name stay as they are; ``changed`` names a new
    one that says whether the text lost words.
    """
    decisions, hit = repeats(df, id_col, text_col, width)
    # an id can repeat, so the text's hash goes with it
    cut = decisions.filter("twin").select("id", "whole", F.lit("").alias("kept"))
    cut = cut.union(decisions.join(left_of(hit), "judge").select("id", "whole", "kept")).distinct()
    names = [free_name(df, n) for n in ("_id", "_whole", "_kept")]
    words = F.array_join(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})")), " ")
    keyed = df.withColumn(names[0], F.col(id_col).cast("long")).withColumn(names[1], F.unhex(F.sha2(words.cast("binary"), 256)))
    out = keyed.join(cut.toDF(*names), names[:2], "left")
    if changed:
        out = out.withColumn(changed, F.col(names[2]).isNotNull())
    return out.withColumn(text_col, F.coalesce(names[2], F.col(text_col))).select(*df.columns, *([changed] if changed else []))


def suspect_windows(text, cells, width, hashes):
    """A suspect's words, their hashes, each window's anchor, and which windows' anchors recur."""
    words = words_of(text)
    h = hashes(words)
    least = anchors(h, width)
    known = np.sort(np.array([c["anchor"] for c in cells], np.int64).view(np.uint64))
    return words, h, least, known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least


def confirmed_passages(suspects: DataFrame, width: int) -> DataFrame:
    """row, id, start, end (in windows): runs of windows that recur and that this row has first."""

    def windows(batches):
        hashes = WordHashes()
        for row, doc, text, cells in rows_of(batches, "row", "id", "text", "cells"):
            _, h, _, suspect = suspect_windows(text, cells, width, hashes)
            at = np.flatnonzero(suspect)
            if len(at):
                a, b = (k[at] for k in window_keys(h, width))
                # a window that a text repeats counts once, at its first place
                _, once = np.unique(a ^ (b * np.uint64(3)), return_index=True)
                n = len(once)
                columns = [pa.array(a[once].view(np.int64)), pa.array(b[once].view(np.int64)), pa.array(np.full(n, doc)), pa.array(np.full(n, row)), pa.array(at[once])]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "id", "row", "at"])

    keys = suspects.mapInArrow(windows, "a long, b long, id long, row long, at long")
    firsts = keys.groupBy("a", "b").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min(F.struct("id", "row", "at")).alias("first")).filter("id < last")
    return firsts.groupBy(F.col("first.row").alias("row")).agg(F.array_sort(F.collect_list("first.at")).alias("places"))


def located(parts: DataFrame, width: int) -> DataFrame:
    """row, start, end: words that lie in windows which an earlier document has."""
    sizes = parts.groupBy("cell").agg(F.sum(F.when(F.col("passage"), F.col("n_words") / (width - PHRASE + 1) + 1)).alias("phrases"), F.sum(F.when(~F.col("passage"), F.col("n_words"))).alias("words"))
    sizes = sizes.filter("phrases is not null and words is not null").select(
        "cell", F.ceil(F.col("phrases") / SHARD_PHRASES).cast("int").alias("slices"), F.ceil(F.col("words") / SHARD_WORDS).cast("int").alias("streams")
    )
    dealt = parts.join(sizes, "cell")
    # a passage is in one slice, for all streams; a region is in one stream, for all slices
    own = F.pmod(F.xxhash64("row", "start"), F.when(F.col("passage"), F.col("slices")).otherwise(F.col("streams"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("passage"), F.col("streams")).otherwise(F.col("slices")) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", others)
    where = [F.when(F.col("passage"), F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("slice", "own", "other"), ("stream", "other", "own"))]
    dealt = dealt.select("cell", *where, (~F.col("passage")).alias("region"), "row", "id", "start", "words")
    key = ["cell", "slice", "stream"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "region").mapInArrow(lambda b: stream(b, width), "row long, start long, end long")


def cell_parts(suspects: DataFrame, width: int) -> DataFrame:
    """A suspect's regions by cell, and its recurring passages by cell: words, and the place of the first."""

    def part(batches):
        hashes = WordHashes()
        for row, doc, text, cells, places in rows_of(batches, "row", "id", "text", "cells", "places"):
            words, _, least, suspect = suspect_windows(text, cells, width, hashes)
            cell_of = {c["anchor"]: c["cell"] for c in cells}
            at = np.flatnonzero(suspect)
            values, index = np.unique(least[at].view(np.int64), return_inverse=True)
            cell = np.zeros(len(least), np.int64)
            cell[at] = np.array([cell_of[int(v)] for v in values], np.int64)[index]
            first = np.zeros(len(least), bool)
            first[places or []] = True
            for c in np.unique(cell[at]).tolist():
                here = suspect & (cell == c)
                for passage, marked in ((True, here & first), (False, here)):
                    if passage or c < doc:
                        for a, b in runs(marked):
                            yield c, passage, row, doc, a, b - a + width - 1, b" ".join(words[a : b + width - 1]).decode("utf-8", "surrogatepass")

    names, types = ("cell", "passage", "row", "id", "start", "n_words", "words"), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return suspects.mapInArrow(lambda b: record_batches(part(b), names, types), "cell long, passage boolean, row long, id long, start long, n_words long, words string")


class PhraseAutomaton:
    """Phrases of passages, over words as 32-bit numbers, and the passages' windows by hash."""

    def __init__(self, passages: list[tuple[int, np.ndarray]], width: int):
        """passages: id and word hashes."""
        self.width = width
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for _, h in passages:
            short = (h & np.uint64(0x7FFFFFFF)).tolist()
            for at in range(0, len(short) - PHRASE + 1, width - PHRASE + 1):
                self.automaton.add_word(tuple(short[at : at + PHRASE]))
        self.automaton.make_automaton()
        self.words = np.concatenate([h for _, h in passages])
        starts = np.cumsum([0, *(len(h) for _, h in passages)])
        keys = np.concatenate([rolling(h, width) for _, h in passages])
        counts = [len(h) - width + 1 for _, h in passages]
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, counts)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.ids = keys[order], at[order], np.repeat([doc for doc, _ in passages], counts)[order]

    def spans(self, doc: int, h: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words of ``h`` that are covered by windows which a passage of a smaller id has."""
        n = len(h) - self.width + 1
        ends = [end for end, _ in self.automaton.iter(tuple((h & np.uint64(0x7FFFFFFF)).tolist()))]
        if not ends or n < 1:
            return []
        # the windows that hold a phrase found: they begin up to width - PHRASE words before it
        first = np.array(ends) - PHRASE + 1
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, np.maximum(first - self.width + PHRASE, 0), 1)
        np.add.at(edges, np.minimum(first + 1, n), -1)
        maybe = np.flatnonzero(np.cumsum(edges)[:n] > 0)
        key = rolling(h, self.width)[maybe]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[place] == key) & (self.ids[place] < doc)
        start, other = maybe[hit], self.at[place[hit]]
        # hits that go on in the same passage are compared with it word by word, as one run
        cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(other) != 1)) + 1
        found = np.zeros(n, bool)
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(start)]):
            if a < b:
                i, j, size = int(start[a]), int(other[a]), b - a + self.width - 1
                same = h[i : i + size] == self.words[j : j + size]
                found[i : i + b - a] = same.all() or [bool(same[k : k + self.width].all()) for k in range(b - a)]
        return [(a, b + self.width - 1) for a, b in runs(found)]


def stream(batches, width):
    """Sorted rows, shard by shard: first its passages, then its regions."""
    hashes, shard, passages, automaton = WordHashes(), None, [], None

    def spans():
        nonlocal shard, passages, automaton
        for cell, part, of, region, row, doc, start, words in rows_of(batches, "cell", "slice", "stream", "region", "row", "id", "start", "words"):
            if (cell, part, of) != shard:
                shard, passages, automaton = (cell, part, of), [], None
            h = hashes(words_of(words))
            if not region:
                passages.append((doc, h))
            elif passages:
                automaton = automaton or PhraseAutomaton(passages, width)
                for a, b in automaton.spans(doc, h):
                    yield row, start + a, start + b

    yield from record_batches(spans(), ("row", "start", "end"), (pa.int64(),) * 3)


def dedup_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """Per row: ``id_col``, n_words, n_removed, kept_sha256."""
    decisions, hit = repeats(df, id_col, text_col, width)
    cut = left_of(hit).select("judge", "n_left", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
    out = decisions.join(cut, "judge", "left")
    n_left = F.when(F.col("twin"), 0).otherwise(F.coalesce("n_left", "n_words"))
    sha = F.when(F.col("twin"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("whole"))))
    return out.select(F.col("id").alias(id_col), "n_words", (F.col("n_words") - n_left).alias("n_removed"), sha.alias("kept_sha256"))
