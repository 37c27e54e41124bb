"""Byte-level BPE by prefix dynamic programming (op5).

For each prefix of a byte string there is exactly one token that its encoding ends with: the one whose
predecessor (the last token of what stands before it) would not have merged with it in another way. The
table of these last tokens is filled from left to right, so bytes can be appended at any time, a walk
backwards gives the encoding of every prefix, and after an edit only the entries near it change.

Null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from poolside.llm.common import in_groups, record_batches, rows_of, text_rows

#: Entries that a worker's memo of pieces or words holds; twice as many at most.
MEMO = 400_000


class Vocabulary:
    """Token bytes by rank; a lower rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.known: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the adjacent parts of lowest rank until none can merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        known = self._halves.get(token, self)
        if known is self:
            data, known = self.tokens[token], None
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                known = self.ranks[parts[0]], self.ranks[parts[1]]
            self._halves[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes.

        The merges that made the two are undone at the place where they meet, the latest first. If what
        then meets would have merged before the merge just undone, the two tokens would never have been made.
        Of equal ranks, the one further left merges first.
        """
        before = 1 << 60
        while True:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right])
            if rank is not None and rank < before:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left and (left > right or not of_right):
                before, left = left, of_left[1]
            elif of_right:
                before, right = right + 1, of_right[0]
            else:
                return True

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The last token of each prefix of ``data``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        if data:
            self.append(data)

    def _fill(self, data: bytes, last: list[int], end: int) -> None:
        """Add the entries of ``last`` up to ``end``."""
        vocabulary = self.vocabulary
        get, known, longest = vocabulary.ranks.get, vocabulary.known, vocabulary.longest
        if len(known) > 1_000_000:
            known.clear()
        for at in range(len(last), end + 1):
            for start in range(at - longest if at > longest else 0, at):
                token = get(data[start:at])
                if token is not None:
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = vocabulary.fits(last[start], token)
                    if fits:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; the entries so far stay as they are."""
        self.data += data
        self._fill(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes start to end; returns how many entries were computed anew.

        An entry depends on the entries and bytes of at most ``longest`` bytes before it, so behind the
        edit it ends once that many entries in a row have come out as they were.
        """
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        last, same, at = old[: start + 1], 0, start + 1
        while at <= len(self.data):
            self._fill(self.data, last, at)
            behind = at - start - len(data)
            same = same + 1 if behind > 0 and last[at] == old[at - shift] else 0
            at += 1
            if same >= self.vocabulary.longest:
                break
        self.last = last + old[at - shift :]
        return at - start - 1

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        at, out = len(self.data) if end is None else end, []
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


class PrefixTables:
    """The prefix tables of many short byte strings at once: one step fills an entry of all of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        by_length: dict[int, list[tuple[int, int]]] = {}
        for token, rank in vocabulary.ranks.items():
            by_length.setdefault(len(token), []).append((int.from_bytes(token[-8:], "big"), rank))
        #: By length, the last 8 bytes of tokens as sorted numbers, and the tokens.
        self.keys = {}
        for n, found in sorted(by_length.items(), reverse=True):
            keys, ranks = zip(*sorted(found))
            self.keys[n] = np.array(keys, np.uint64), np.array(ranks, np.int64)
        self.sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair (left << 32 | right) fit side by side."""
        distinct, index = np.unique(pairs, return_inverse=True)
        known, found = self.vocabulary.known, []
        if len(known) > 1_000_000:
            known.clear()
        for pair in distinct.tolist():
            ok = known.get(pair)
            if ok is None:
                ok = known[pair] = self.vocabulary.fits(pair >> 32, pair & 0xFFFFFFFF)
            found.append(ok)
        return np.array(found, bool)[index]

    def encode(self, strings: list[bytes]) -> list[bytes]:
        """Ids of each string, 4 little-endian bytes each."""
        if not strings:
            return []
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        sizes = np.array([len(strings[i]) for i in order])
        longest = int(sizes[0])
        data = np.zeros((len(order), longest), np.uint8)
        data[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join([strings[i] for i in order]), np.uint8)
        last, tail = np.full((len(order), longest + 1), -1, np.int64), np.zeros(len(order), np.uint64)
        for at in range(1, longest + 1):
            live = int(np.searchsorted(-sizes, -at, side="right"))
            tail = tail[:live] << np.uint64(8) | data[:live, at - 1]
            left = np.arange(live)
            for n, (keys, ranks) in self.keys.items():
                if n > at:
                    continue
                if not len(left):
                    break
                key = tail[left] & np.uint64((1 << 8 * min(n, 8)) - 1)
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[place] == key
                rows, tokens = left[hit], ranks[place[hit]]
                if n > 8 and len(rows):  # several tokens can have these last bytes: look up the whole
                    whole = [self.vocabulary.ranks.get(data[r, at - n : at].tobytes(), -1) for r in rows.tolist()]
                    tokens = np.array(whole, np.int64)
                    rows, tokens = rows[tokens >= 0], tokens[tokens >= 0]
                if n < at and len(rows):
                    ok = self.fits(last[rows, at - n] << 32 | tokens)
                    rows, tokens = rows[ok], tokens[ok]
                if len(rows):
                    last[rows, at] = tokens
                    left = left[last[left, at] < 0]
            if len(left):
                raise ValueError("the vocabulary lacks a byte")
        # walk all strings backwards, then write their ids forwards
        at, walked = sizes.copy(), []
        rows = np.flatnonzero(at)
        while len(rows):
            tokens = last[rows, at[rows]]
            walked.append((rows, tokens))
            at[rows] -= self.sizes[tokens]
            rows = rows[at[rows] > 0]
        counts = np.zeros(len(order), np.int64)
        for rows, _ in walked:
            counts[rows] += 1
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), "<u4")
        for step, (rows, tokens) in enumerate(walked, 1):
            flat[ends[rows] - step] = tokens
        ids, out = flat.tobytes(), [b""] * len(order)
        for i, a, b in zip(order, (4 * (ends - counts)).tolist(), (4 * ends).tolist()):
            out[i] = ids[a:b]
        return out


class Encoder:
    """Encodes whole texts; each match of ``pattern`` is encoded by a prefix table. Words met before are remembered, up to a bound."""

    #: Between two neighbours that aren't white space, a single space always starts a match.
    _RUN = regex.compile(r"\s\s")
    #: Matches of up to so many bytes are encoded together.
    _SHORT = 48

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern, self.tables = vocabulary, regex.compile(pattern), PrefixTables(vocabulary)
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """A text's matches; without runs of white space, they never cross a single space, so words (of one match or more) do too."""
        if self._RUN.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + word for word in rest]]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, 4 little-endian bytes each."""
        find = self.pattern.findall
        matches = {w: find(w) for w in words}
        pieces = list({p for found in matches.values() for p in found})
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [d for d in data if len(d) <= self._SHORT]
        coded = dict(zip(short, self.tables.encode(short)))
        for d in data:
            if len(d) > self._SHORT:
                coded[d] = np.array(PrefixTable(self.vocabulary, d).tokens(), "<u4").tobytes()
        of = {p: coded[d] for p, d in zip(pieces, data)}
        return {w: of[found[0]] if len(found) == 1 else b"".join([of[p] for p in found]) for w, found in matches.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, 4 little-endian bytes each."""
        pieces = [self._pieces(t) for t in texts]
        new, old, known, missing = self._new, self._old, {}, []
        for w in {p for found in pieces for p in found}:
            ids = new.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    missing.append(w)
                    continue
            known[w] = ids
        known |= self._learn(missing)
        if len(new) + len(known) > MEMO:
            self._old, self._new = new, {}
        self._new.update((w, ids) for w, ids in known.items() if len(w) <= 64)
        return [b"".join([known[p] for p in found]) for found in pieces]


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def encoded(batches, ranks_path: str, pattern: str):
    """(id, ids) of rows (id, text), some texts at a time."""
    encoder = encoder_of(ranks_path, pattern)
    for group in in_groups(rows_of(batches, "id", "text"), lambda r: len(r[1]), 2 << 20):
        yield from zip([doc for doc, _ in group], encoder.encode([text for _, text in group]))


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ids (binary: 4 little-endian bytes each) and decoded (binary: the bytes of these ids)."""

    def run(batches):
        decode = encoder_of(ranks_path, pattern).vocabulary.decode
        rows = ((doc, ids, decode(np.frombuffer(ids, "<u4").tolist())) for doc, ids in encoded(batches, ranks_path, pattern))
        yield from record_batches(rows, (id_col, "ids", "decoded"), (pa.int64(), pa.binary(), pa.binary()))

    return text_rows(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, ids binary, decoded binary")


def bpe_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_tokens, ids_sha256, decoded_sha256; the ids themselves don't leave the task."""

    def run(batches):
        def rows():
            decode = encoder_of(ranks_path, pattern).vocabulary.decode
            for doc, ids in encoded(batches, ranks_path, pattern):
                back = decode(np.frombuffer(ids, "<u4").tolist())
                yield doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield from record_batches(rows(), (id_col, "n_tokens", "ids_sha256", "decoded_sha256"), types)

    return text_rows(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
