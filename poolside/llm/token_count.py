"""Greedy word-piece lengths from a longest-match automaton (op2).

A word is cut greedily from the left into the longest pieces of a vocabulary; the automaton reads each
character once. Its states are the nodes of two tries, one of pieces that start a word and one of pieces
that continue it. Where a node has no child for the next character, its failure link leads to the state
that is reached after the longest pieces so far are cut off ("popped"), and their number was counted when
the automaton was built. So a word's length in pieces is a sum of such numbers, and no piece is built.

A word that can't be cut counts as one unknown token. Null and empty texts have no words.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from poolside.llm.common import rows_of, text_rows

#: Words that a worker remembers; twice as many at most are held.
MEMO = 200_000


class PieceAutomaton:
    """Counts the pieces of words; ``initial`` pieces start a word, ``inner`` pieces continue it."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        is_piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = self.go[node].get(c)
                    if child is None:
                        child = len(self.go)
                        self.go[node][c] = child
                        self.go.append({})
                        is_piece.append(False)
                    node = child
                is_piece[node] |= node > 1
        # failure link (-1: none) and number of pieces popped on the way there
        self.fail = [-1] * len(self.go)
        self.pops = [0] * len(self.go)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.go[parent].items():
                if is_piece[node]:
                    self.fail[node], self.pops[node] = 1, 1
                else:
                    at, popped = self.fail[parent], self.pops[parent]
                    while at >= 0 and c not in self.go[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.go[at][c], popped
                queue.append(node)

    def count(self, word: str) -> int:
        """Number of pieces, or 0 if the word can't be cut into pieces."""
        go, fail, pops = self.go, self.fail, self.pops
        at = n = 0
        for c in word:
            while (to := go[at].get(c)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at != 1:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


def pieces_of(path: str) -> tuple[set[str], set[str]]:
    """Word-initial and inner pieces of a sentencepiece model: those with and without its word mark.

    Single characters count as both, so only a character outside the vocabulary makes a word unknown.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, inner = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if "▁" in piece:
            if len(piece) > 1 and "▁" not in piece[1:] and piece[0] == "▁":
                initial.add(piece[1:])
        else:
            inner.add(piece)
    single = {p for p in initial | inner if len(p) == 1}
    return initial | single, inner | single


@lru_cache(maxsize=1)
def automaton_of(path: str) -> PieceAutomaton:
    return PieceAutomaton(*pieces_of(path))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_words, n_tokens, n_unknown (words that count as one unknown token).

    One pass without a shuffle. A batch's words are counted first, so each distinct one is looked up once;
    the memo is bounded, and a word that fell out of it is counted again.
    """
    schema = f"`{id_col}` long, n_words long, n_tokens long, n_unknown long"

    def count(batches):
        automaton, new, old = automaton_of(vocabulary), {}, {}
        ids, sums = [], []
        for doc, text in rows_of(batches, "id", "text"):
            words = Counter(text.encode("utf-8", "surrogatepass").split())
            n_words = n_tokens = n_unknown = 0
            for word, times in words.items():
                n = new.get(word)
                if n is None:
                    n = old.get(word)
                    if n is None:
                        n = automaton.count(word.decode("utf-8", "surrogatepass"))
                    if len(new) >= MEMO:
                        old, new = new, {}
                    new[word] = n
                n_words += times
                n_tokens += times * (n or 1)
                n_unknown += 0 if n else times
            ids.append(doc)
            sums.append((n_words, n_tokens, n_unknown))
            if len(ids) == 4096:
                yield as_batch(ids, sums)
                ids, sums = [], []
        if ids:
            yield as_batch(ids, sums)

    def as_batch(ids, sums):
        columns = [ids, *zip(*sums)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return text_rows(df, id_col, text_col).mapInArrow(count, schema)
