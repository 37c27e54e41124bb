"""Personal data and the terms that give it away (op12).

Base spans are e-mail addresses, IP addresses, card and phone numbers by fixed patterns. The method adds what the
corpus says: a term that stands near a protected entity in most of the documents that have the term tells who is
meant, even with the entity itself blanked out.

1. One pass over whole texts finds base spans, and the ``window`` words on either side of each as its context, words
   that touch a base span excepted. So there are at most 2 ``window`` rows for an entity's mention.
2. Documents with an entity, with a term, and with the term in the entity's context are counted over all rows. Terms
   are counted where they can matter only: those in contexts of one entity in ``support`` documents or more; a filter
   of their hashes (``BLOOM`` bytes at any size) goes to the tasks, and what passes it by chance is joined away.
3. With p(c) the share of documents that have entity c, its information is IC(c) = -log2 p(c), and a term tells
   PMI(c; t) = log2(p(c, t) / (p(c) p(t))) of it; it discloses c where that is at least ``threshold`` of IC(c).
4. A disclosing term becomes its class (number, code, capitalised, word) where the class itself, counted like a term,
   tells less than the threshold, and is removed otherwise. Base spans become their kind.

Documents are rows: copies count as often as they are there. An entity in one document only discloses nothing by this
rule unless ``support`` is 1. Null and empty texts have no spans; null ids stay, as do repeated rows, each for itself.
Texts of any length are read whole, in time linear in their length. Spans of different kinds may overlap, terms never
overlap base spans. An empty table gives no rows. Extra columns of any name stay as they are in ``sanitised``, and are
not read by ``privacy_digests``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolside.llm.common import free_name, record_batches, rows_of, staged

#: Kinds in the order of their spans; the last is the method's.
KINDS, TERM = ("email", "ip", "card", "phone"), "term"
#: An e-mail's name is taken as a whole run, and a first number as a whole run: no later start in it can match instead.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]+\.[0-9]+\.[0-9]+)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_](?:[\w'’-]*[^\W_])?")
DIGIT = re.compile(r"\d")
#: Bytes of the filter of counted terms; bits that a term sets.
BLOOM, SET = 1 << 21, 3
#: Distinct terms that a task counts before it hands them on; words whose hashes it remembers.
HELD = 200_000


def luhn(digits: str) -> bool:
    """Whether the digits pass the check sum of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in EMAIL.finditer(text) if m.group(1)]
    if "." in text:
        for m in IP.finditer(text):
            if m.group(1) and all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in m.group().split("."))):
                found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return found


def written(spans) -> str:
    """Spans as text, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def hashed(text: str) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def term_class(word: str) -> str:
    """The class that a disclosing term is generalised to; classes are counted under these names, which no word has."""
    if word.isdigit():
        return "<number>"
    if DIGIT.search(word):
        return "<code>"
    return "<capitalised>" if word[:1].isupper() else "<word>"


CLASS_HASHES = {c: hashed(c) for c in ("<number>", "<code>", "<capitalised>", "<word>")}


def contexts(text: str, spans, window: int):
    """(entity hash, term hash, class, start, end) of the words around each base span that touch none."""
    if not spans:
        return
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    covered = set()
    for _, a, b in spans:
        covered.update(range(bisect_right(ends, a), bisect_left(starts, b)))
    for kind, a, b in spans:
        entity = hashed(f"{kind}:{text[a:b].lower()}")
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        for at in (*range(max(0, before - window), before), *range(after, min(len(words), after + window))):
            if at not in covered:
                word = text[slice(*words[at])]
                yield entity, hashed(word.lower()), term_class(word), *words[at]


def read_texts(batches, window):
    """Per row: number, id, kinds' counts, base spans, and contexts."""
    for row, d, text in rows_of(batches, "row", "id", "text"):
        spans = base_spans(text or "")
        counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
        yield (row, d, *counts, written(spans), [dict(zip(("entity", "term", "class", "start", "end"), c)) for c in contexts(text or "", spans, window)])


READ = "row long, id long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<entity: long, term: long, class: string, start: int, end: int>>"
NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("class", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def places(terms: np.ndarray) -> np.ndarray:
    """The bits of the filter that terms set."""
    h = terms.view(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[:SET]
    return (h >> np.uint64(20)) % np.uint64(BLOOM * 8)


def term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of hashes; tasks send bits that they set, and equal ones are merged before the driver."""

    def bits(batches):
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy()))
            words, inverse = np.unique(at >> np.uint64(5), return_inverse=True)
            value = np.zeros(len(words), np.int64)
            np.bitwise_or.at(value, inverse, np.int64(1) << (at & np.uint64(31)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(value)], names=["word", "value"])

    out = np.zeros(BLOOM // 4, np.uint32)
    for batch in terms.mapInArrow(bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def documents_with(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: documents that have each of ``terms`` (one column of hashes) or class."""
    chosen = texts.sparkSession.sparkContext.broadcast(term_filter(terms))  # of one size for all inputs

    def passing(words):
        """Per word the hashes of it and its class, without those that the filter has not."""
        keys = np.array([(hashed(w.lower()), CLASS_HASHES[term_class(w)]) for w in words], np.int64)
        at = places(keys.reshape(-1))
        passed = ((chosen.value[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & 1).all(axis=1).reshape(-1, 2)
        return [tuple(k for k, p in zip(*row) if p) for row in zip(keys.tolist(), passed.tolist())]

    def count(batches):
        counts, known = {}, {}
        for (text,) in rows_of(batches, "text"):
            words = set(WORD.findall(text or ""))
            if new := [w for w in words if w not in known]:
                if len(known) > HELD:
                    known = {}
                    new = list(words)
                known.update(zip(new, passing(new)))
            for k in {k for w in words for k in known[w]}:
                counts[k] = counts.get(k, 0) + 1
            if len(counts) >= HELD:
                yield from counts.items()
                counts = {}
        yield from counts.items()

    found = texts.mapInArrow(lambda b: record_batches(count(b), ["term", "n_term"], [pa.int64()] * 2), "term long, n_term long")
    return found.groupBy("term").agg(F.sum("n_term").alias("n_term"))


def disclosing(near: DataFrame, texts: DataFrame, n: int, threshold: float, support: int) -> DataFrame:
    """entity, term, class, goes: pairs over the threshold, and whether the class is over it, too, so the term goes."""
    pairs = near.select("entity", "term", "class").distinct()
    both = staged(near.select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support))
    entities = near.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    in_class = near.select("row", "entity", "class").distinct().groupBy("entity", "class").agg(F.count("*").alias("n_class_both"))
    classes = texts.sparkSession.sql("VALUES " + ", ".join(f"('{c}', {h}L)" for c, h in CLASS_HASHES.items())).toDF("class", "class_term")
    counted = staged(documents_with(texts, both.select("term").distinct().union(classes.select("class_term"))))
    of_class = F.broadcast(classes.join(counted.withColumnRenamed("term", "class_term").withColumnRenamed("n_term", "n_class"), "class_term").select("class", "n_class"))  # four rows
    information = F.log2(F.lit(float(n)) / F.col("n_entity"))

    def tells(together, alone):
        return F.log2(F.lit(float(n)) * F.col(together) / (F.col("n_entity") * F.col(alone)))

    held = both.join(entities, "entity").join(counted, "term").filter((information > 0) & (tells("n_both", "n_term") >= threshold * information))
    known = held.join(pairs, ["entity", "term"]).join(in_class, ["entity", "class"]).join(of_class, "class")
    return known.select("entity", "term", "class", (tells("n_class_both", "n_class") >= threshold * information).alias("goes"))


def read(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    types = [pa.int64()] * 6 + [pa.string(), NEAR]
    names = [x.split()[0] for x in READ.split(" array")[0].split(", ")]
    return staged(texts.mapInArrow(lambda b: record_batches(read_texts(b, window), names, types), READ))


def spans_of(rows: DataFrame, texts: DataFrame, threshold: float, support: int) -> DataFrame:
    """row, added: per row with disclosing terms, their distinct (start, end, class, goes) by start."""
    near = rows.filter(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    told = disclosing(near, texts, rows.count(), threshold, support)
    hits = near.join(told, ["entity", "term", "class"])
    return hits.groupBy("row", "start", "end", "class").agg(F.max("goes").alias("goes")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "class", "goes"))).alias("added"))


def privacy_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, threshold: float = 0.9, support: int = 2) -> DataFrame:
    """Per row: ``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans (base ones, then terms)."""
    rows = read(df, id_col, text_col, window)
    added = spans_of(rows, df.select(F.col(text_col).alias("text")), threshold, support)
    extra = F.array_join(F.transform("added", lambda x: F.concat(F.lit(f"{TERM}:"), x.start.cast("string"), F.lit(":"), x.end.cast("string"))), ",")
    full = rows.drop("near").join(added, "row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("added").isNotNull(), extra))
    return full.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def blanked(text: str, base: str, added) -> str:
    """The text with base spans as their kinds, and disclosing terms as their class or removed."""
    spans = [(int(a), int(b), f"[{k}]") for k, a, b in (s.split(":") for s in base.split(","))] if base else []
    spans += [(x["start"], x["end"], "" if x["goes"] else x["class"]) for x in added or ()]
    out, at = [], 0
    for a, b, to in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], to]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, threshold: float = 0.9, support: int = 2) -> DataFrame:
    """``df`` with its texts blanked and generalised; overlapping spans are blanked as one. Null texts stay null."""
    number = free_name(df, "_row")
    held = staged(df.withColumn(number, F.monotonically_increasing_id()))
    texts = held.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    types = [pa.int64()] * 6 + [pa.string(), NEAR]
    names = [x.split()[0] for x in READ.split(" array")[0].split(", ")]
    rows = staged(texts.mapInArrow(lambda b: record_batches(read_texts(b, window), names, types), READ))
    found = rows.join(spans_of(rows, texts.select("text"), threshold, support), "row", "left").filter("base != ''").select("row", "base", "added")

    def rewrite(batches):
        for row, text, base, added in rows_of(batches, "row", "text", "base", "added"):
            yield row, blanked(text, base, added)

    new = texts.join(found, "row").select("row", "text", "base", "added").mapInArrow(lambda b: record_batches(rewrite(b), ["row", "new"], [pa.int64(), pa.string()]), "row long, new string")
    to = free_name(df, "_new")
    full = held.join(new.select(F.col("row").alias(number), F.col("new").alias(to)), number, "left")
    return full.select(*[F.coalesce(F.col(to), F.col(c)).alias(c) if c == text_col else F.col(c) for c in df.columns])
