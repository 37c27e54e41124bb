"""Language identification by a bidirectional gated recurrent network over bytes (op3).

A text is cut into windows at white space (a word with a space in front; words over ``WINDOW`` bytes are cut
again, between characters, and all their windows are learned from). The network reads a window's bytes from both ends and labels every position with a probability for
each language; a text's probabilities are the mean over all its positions. Windows are labelled apart from
each other, so equal ones are labelled once.

The network is trained here, in numpy, by backpropagation through time, on a bounded sample: about
``train_rows`` rows, chosen by a hash of their id evenly over the languages, and of their words the
``train_words`` most frequent ones. Null texts and texts without a letter are ``und`` with score 0. Rows
whose id is null are labelled but not learned from. Repeated rows stay. Very long texts are read whole. Without a row to learn
from, the only language is ``und``. Columns other than the named ones can have any name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from poolside.llm.common import WORD

#: Bytes of a window, the space in front included.
WINDOW = 24
#: Windows whose labels a worker remembers.
MEMO = 300_000
LETTER = regex.compile(r"\p{L}")


def sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, word) and lengths; words of at most ``WINDOW`` bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    out = np.zeros((len(words), max(int(lengths.max()), 1)), np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return np.ascontiguousarray(out.T), lengths


@dataclass
class BiGru:
    """Weights by direction: ``x`` (256, 3H) for bytes, ``u`` (H, 3H) for the state; ``v`` and ``c`` for the output."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, seed: int = 7) -> BiGru:
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w["x" + side] = rng.normal(0, 0.3, (256, 3 * hidden))
            w["u" + side] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            w["v" + side] = rng.normal(0, 0.3, (hidden, len(langs)))
        w["c"] = np.zeros(len(langs))
        return cls(langs, {k: a.astype(np.float32) for k, a in w.items()})

    def states(self, x: np.ndarray, lengths: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (time, word, H) after each byte, read from the front ("f") or the back ("b")."""
        steps, n = x.shape
        u, wx = self.w["u" + side], self.w["x" + side]
        hidden = u.shape[0]
        h, out = np.zeros((n, hidden), np.float32), np.zeros((steps, n, hidden), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            here = (t < lengths)[:, None]
            a, s = wx[x[t]], h @ u
            gates = sigmoid(a[:, : 2 * hidden] + s[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            m = np.tanh(a[:, 2 * hidden :] + r * s[:, 2 * hidden :])
            new = np.where(here, m + z * (h - m), h)
            if keep is not None:
                keep.append((t, here, h, z, r, m, s[:, 2 * hidden :]))
            h = out[t] = new
        return out

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, word, language); what lies behind a word's end is to be left out."""
        logits = self.states(x, lengths, "f") @ self.w["vf"] + self.states(x, lengths, "b") @ self.w["vb"] + self.w["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def sums(self, words: list[bytes]) -> np.ndarray:
        """The sum over a window's positions of the language probabilities, one row each."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 2048):
            rows = order[at : at + 2048]
            x, lengths = padded([words[i] for i in rows])
            p = self.probabilities(x, lengths)
            out[rows] = (p * (np.arange(len(x))[:, None] < lengths)[:, :, None]).sum(axis=0)
        return out

    def labels(self, text: str) -> list[str]:
        """The language of every byte position of a text's windows, white space left out."""
        found = []
        for window in (w for word in words_of(text) for w in cut(word)):
            x, lengths = padded([window])
            best = self.probabilities(x, lengths)[:, 0].argmax(axis=1).tolist()
            found += [self.langs[i] for i in (best[1:] if window[:1] == b" " else best)]
        return found

    def gradients(self, x, lengths, target, weight) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy at all positions, by backpropagation through time."""
        kept = {side: [] for side in "fb"}
        h = {side: self.states(x, lengths, side, kept[side]) for side in "fb"}
        logits = h["f"] @ self.w["vf"] + h["b"] @ self.w["vb"] + self.w["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(len(target)), target] -= 1
        d *= ((np.arange(len(x))[:, None] < lengths) * (weight / lengths))[:, :, None].astype(np.float32)
        g = {"c": d.sum(axis=(0, 1))}
        for side in "fb":
            u = self.w["u" + side]
            hidden = u.shape[0]
            g["v" + side] = np.tensordot(h[side], d, ((0, 1), (0, 1)))
            gx, gu, dh = np.zeros_like(self.w["x" + side]), np.zeros_like(u), np.zeros((x.shape[1], hidden), np.float32)
            into = d @ self.w["v" + side].T
            for t, here, before, z, r, m, s in reversed(kept[side]):
                dh = dh + into[t]
                live = np.where(here, dh, 0)
                dm = live * (1 - z) * (1 - m * m)
                dz = live * (before - m) * z * (1 - z)
                dr = dm * s * r * (1 - r)
                da = np.concatenate([dz, dr, dm], axis=1)
                ds = np.concatenate([dz, dr, dm * r], axis=1)
                np.add.at(gx, x[t], da)
                gu += before.T @ ds
                dh = np.where(here, dh * z, dh) + ds @ u.T
            g["x" + side], g["u" + side] = gx, gu
        return g

    def train(self, words: list[bytes], target: np.ndarray, weight: np.ndarray, epochs: int = 4, batch: int = 512, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over batches of words of about the same length."""
        rng = np.random.default_rng(seed)
        order = np.argsort([len(w) for w in words], kind="stable")
        chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
        first, second, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(epochs):
            for i in rng.permutation(len(chunks)):
                rows = chunks[i]
                x, lengths = padded([words[j] for j in rows])
                g = self.gradients(x, lengths, target[rows], weight[rows] / weight[rows].sum())
                step += 1
                pace = rate * 0.5 ** epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, a in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * a
                    second[k] = 0.999 * second[k] + 0.001 * a * a
                    self.w[k] -= (pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


def cut(word: bytes) -> list[bytes]:
    """The windows of a word, a space in front of it; no character is cut in two."""
    word = b" " + word
    out = []
    while len(word) > WINDOW:
        end = WINDOW
        while end > WINDOW - 4 and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[:end])
        word = word[end:]
    return [*out, word]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def train_language_model(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 4000, train_words: int = 60_000, hidden: int = 16, epochs: int = 4
) -> BiGru:
    """A network that has learned the languages of the rows of ``df``; rows without id, text or language don't count.

    About ``train_rows`` rows (twice as many at most) are read whole; their words are counted by language in
    Spark, and the driver gets the ``train_words`` most frequent pairs.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).na.drop()
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return BiGru.fresh(["und"], hidden)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, train_rows / len(langs) / n).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang").limit(2 * train_rows)
    words = picked.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    seen = words.orderBy(F.desc("n"), F.xxhash64("word", "lang"), "word", "lang").limit(train_words).collect()
    total = Counter()
    for r in seen:
        total[r["lang"]] += r["n"] ** 0.5
    found = sorted((w, langs.index(r["lang"]), r["n"] ** 0.5 / total[r["lang"]]) for r in seen for w in cut(words_of(r["word"])[0]))
    model = BiGru.fresh(langs, hidden)
    if len(langs) > 1:
        words, target, weight = zip(*found)
        model.train(list(words), np.array(target), np.array(weight), epochs)
    return model


class Labeller:
    """Labels whole texts; remembers the sums and lengths of words that it has seen."""

    def __init__(self, model: BiGru):
        self.model, self.index = model, {}
        self.table, self.bytes = np.empty((0, len(model.langs)), np.float32), np.empty(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        parts = [cut(word) for word in words]
        sums = self.model.sums([w for ws in parts for w in ws])
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        self.table = np.concatenate([self.table, np.add.reduceat(sums, starts)])
        self.bytes = np.concatenate([self.bytes, np.fromiter((len(word) + 1 for word in words), np.int64, len(words))])

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        if len(self.index) > MEMO:
            self.index, self.table, self.bytes = {}, self.table[:0], self.bytes[:0]
        index, rows, times, ends, new = self.index, [], [], [0], []
        for text in texts:
            words = Counter(words_of(text))
            found = list(map(index.get, words))
            if None in found:
                for i, word in enumerate(words):
                    if found[i] is None:
                        found[i] = index[word] = len(index)
                        new.append(word)
            rows += found
            times += words.values()
            ends.append(len(rows))
        if new:
            self._learn(new)
        rows, times, of = np.array(rows, np.int64), np.array(times), np.repeat(np.arange(len(texts)), np.diff(ends))
        sums = np.stack([np.bincount(of, self.table[rows, k] * times, len(texts)) for k in range(len(self.model.langs))], axis=1)
        size = np.bincount(of, self.bytes[rows] * times, len(texts))
        out = []
        for i, text in enumerate(texts):
            if LETTER.search(text):
                p = sums[i] / size[i]
                best = int(p.argmax())
                out.append((self.model.langs[best], min(1.0, float(p[best]))))
            else:
                out.append(("und", 0.0))
        return out


def detect_languages(df: DataFrame, model: BiGru, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The rows of ``df`` with their language and its score, in columns of these names (in place of any that have them). One pass, without a shuffle."""
    df = df.drop(lang_name, score_name)

    def label(batches):
        labeller = Labeller(model)
        for batch in batches:
            texts = batch.schema.get_field_index(text_col)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = labeller([t or "" for t in part.column(texts).to_pylist()])
                columns = [*part.columns, pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, lang_name, score_name])

    return df.mapInArrow(label, StructType([*df.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out from learning; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def language_predictions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """Per row: ``id_col``, held_out, lang_pred, score; learned from the rows that aren't held out."""
    model = train_language_model(df.filter(~held_out(id_col)), id_col, text_col, lang_col, **training)
    return detect_languages(df.select(id_col, text_col), model, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
