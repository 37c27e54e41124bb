"""Prefix tries, personal data and whitening against brute force, and their edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolside.llm import prefix_trie, privacy, whitening

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as they are dealt, so nodes are shared by several."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, text[:32], hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    for turns in own.values():
        turns.sort()
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple((x[2], x[5]) for x in own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) or 1
        saved[s] = sum(saved[k] for k in children[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n=150):
    """Conversations of few different turns, so that many share beginnings, and copies of whole ones."""
    rng, rows = random.Random(seed), []
    for c in range(-20, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9, 14, 25])):
            text = "same" if c % 3 == 0 else rng.choice(["a", "b", "é中", None, "a longer text"])
            rows.append((c, t if rng.random() > 0.02 else None, rng.choice(["user", "assistant", None]) if c % 7 == 0 else "user", text))
    return rows + rows[:5] + [(None, 1, "user", "x")]


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_trie_is_brute_force(many_ranges, block):
    rows = talk(block)
    df = many_ranges.createDataFrame(rows, TURNS).withColumns({c: F.lit("other") for c in ("c", "i", "digest", "shard", "depth", "n_convs")}).repartition(3)
    got = prefix_trie.conversation_trie(df, block=block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_makes_few_points(many_ranges):
    """Points are branches, ends and leaves: at most two for each distinct conversation, however long the edges."""
    rows = [(c, t, "user", "x" if t < 40 else f"{c} {t}") for c in range(0, 100, 5) for t in range(60)]
    turns, convs = prefix_trie.ordered_turns(many_ranges.createDataFrame(rows, TURNS), "conv_id", "turn", "role", "text")
    strands = prefix_trie.strands_of(turns, convs, 4096)
    assert strands.count() == 20
    walk, points = None, 0
    for r in sorted(strands.collect(), key=lambda r: bytes(r["key"])):
        if walk is None:
            walk = prefix_trie.Walk(np.zeros(2, np.uint64), 0, -1, True)
        points += sum(1 for _ in walk.leave(prefix_trie.agreeing(walk.key, bytes(r["key"]))))
        walk.add(bytes(r["key"]), r["sizes"], 1, r["c"], 1, [None])
    points += sum(1 for _ in walk.close())
    assert points == 20 + 1 + 1  # leaves, the branch at 40, the root


@pytest.mark.parametrize("rows", [[], [(7, 0, "u", "x")], [(1, None, None, None), (1, None, None, None), (2, 5, "", "z" * 500_000)], [(None, 1, "u", "x")], [(6, 0, "u", "t"), (8, 0, "u", "t"), (10, 0, "u", "t")]])
def test_trie_of_few_rows(spark, rows):
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_trie_pieces_of_many_ends():
    ids = list(range(20_000))
    rows = list(prefix_trie.pieces([batch([(1, 2, c) for c in ids], ("k1", "k2", "c"))]))
    assert len(rows) == 3
    [(_, _, got)] = prefix_trie.ends_hash([batch([(a, b, t) for a, b, _, t in rows], ("k1", "k2", "text"))])
    assert got == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def batch(rows, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list(names))


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The patterns as they are written."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            doubled = [int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits))]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "x-y", "d.e", "_", "1", "25", "255", "300", "0", "00", "+", " ", "-", "(", ")", "4539 1488 0343 6467", "4539148803436467", "+1 (386) 555-3733", "10.0.0.1", "é", ",", "u@v.w", "@q.r@s.t"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert privacy.base_spans(text) == plain_spans(text), text
    assert privacy.base_spans("x" * 400_000 + "1" * 400_000 + "+" * 1000 + " a@b.c") == [("email", 801_001, 801_006)]


def brute_privacy(rows, window, threshold, support):
    """Spans of each row, from counts by the definition."""
    found, near = [], []
    for text in (t or "" for _, t in rows):
        spans, words = plain_spans(text), [m.span() for m in privacy.WORD.finditer(text)]
        free = [(i, w) for i, w in enumerate(words) if not any(w[0] < b and a < w[1] for _, a, b in spans)]
        of = set()
        for kind, a, b in spans:
            before = [i for i, w in enumerate(words) if w[1] <= a][-window:]
            after = [i for i, w in enumerate(words) if w[0] >= b][:window]
            of |= {(f"{kind}:{text[a:b].lower()}", text[w[0] : w[1]].lower(), w) for i, w in free if i in before or i in after}
        found.append(spans)
        near.append(of)
    n = len(rows)
    have = Counter(t for _, text in rows for t in {w.lower() for w in privacy.WORD.findall(text or "")})
    entities = Counter(e for of in near for e in {e for e, _, _ in of})
    both = Counter(p for of in near for p in {(e, t) for e, t, _ in of})
    out = []
    for spans, of in zip(found, near):
        told = set()
        for e, t, w in of:
            information = math.log2(n / entities[e])
            if both[e, t] >= support and information > 0 and math.log2(n * both[e, t] / (entities[e] * have[t])) >= threshold * information - 1e-12:
                told.add(w)
        out.append((spans, sorted(told)))
    return out


@pytest.fixture(scope="module")
def mails():
    rng = random.Random(4)
    words = ["the", "and", "Of", "ran", "in", "park", "dog-house", "x1", "77"]
    rows = []
    for d in range(120):
        who = rng.randrange(8)
        near = [f"nick{who}", f"Street{who}"] if who < 4 else []
        text = rng.choices(words, k=12) + near + [f"p{who}@mail.example", "10.0.0.7" if who == 2 else "so"] + rng.choices(words, k=10)
        rows.append((d, " ".join(text if rng.random() < 0.6 else rng.choices(words, k=30))))
    return rows + [(200, None), (201, ""), (None, rows[0][1]), (0, rows[0][1])]


def test_privacy_is_brute_force(spark, mails):
    df = spark.createDataFrame(mails, "doc_id long, text string").withColumns({c: F.lit("other") for c in ("id", "row", "term", "base", "near")})
    got = privacy.privacy_digests(df.repartition(3)).collect()
    want = []
    for (d, _), (spans, told) in zip(mails, brute_privacy(mails, 8, 0.9, 2)):
        base = privacy.written(spans)
        every = ",".join(x for x in (base, privacy.written([("term", *w) for w in told])) if x)
        want.append((d, *[sum(k == kind for k, _, _ in spans) for kind in PLAIN], hashlib.sha256(base.encode()).hexdigest(), every))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum("term:" in r["spans"] for r in got) > 20
    assert all("term:" not in r["spans"] for r in got if not (r["n_email"] or r["n_ip"]))


def test_sanitised_texts(spark, mails):
    df = spark.createDataFrame(mails, "doc_id long, text string").withColumn("_row", F.lit(3))
    got = {r["doc_id"]: r for r in privacy.sanitised(df).collect()}
    for d, text in mails:
        new = got[d]["text"]
        assert got[d]["_row"] == 3 and (new is None) == (text is None)
        if text and "@" not in text:
            assert new == text
        if new and "@" in text:
            assert "@" not in new and not re.search(r"\bnick[0-3]\b", new)
    assert privacy.sanitised(df.limit(0)).collect() == [] and privacy.privacy_digests(df.limit(0)).collect() == []


VECTORS = "vec_id long, embedding array<float>, id string, x string, deviation string"


def vectors(rows):
    return [(i, v, "other", "other", "other") for i, v in rows]


def brute_whitening(rows, components=32):
    longest = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (longest - len(v)) for _, v in rows], float)
    values, vectors_ = np.linalg.eigh(np.cov(x.T, bias=True))
    order = np.argsort(values)[::-1][:components]
    n, s = len(rows), x.sum(axis=0)
    return x, n, values[order], (x - x.mean(axis=0)) @ vectors_[:, order] / np.sqrt(values[order]), [int(sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for row in x], values.sum()


@pytest.mark.parametrize("decay", [0.6, 0.01])
def test_whitening_is_brute_force(spark, decay):
    """Steep spectra end on a small basis; flat ones widen it to all dimensions."""
    rng = np.random.default_rng(2)
    data = rng.standard_normal((400, 40)) * 40 * np.exp(-decay * np.arange(40))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(5, data[5].tolist())]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] * 40)]
    k = 6
    got = whitening.whiten(spark.createDataFrame(vectors(rows + bad), VECTORS).repartition(3), components=k, oversampling=6).collect()
    _, n, values, white, deviation, trace = brute_whitening(rows, k)
    assert len(got) == k * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-8
    signs = {}
    at = {i: a for a, (i, _) in enumerate(rows)}
    for r in got:
        a, c = at[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == deviation[a]
        assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
        sign = signs.setdefault(c, np.sign(r["whitened"] * white[a, c]))
        assert sign * r["whitened"] == pytest.approx(white[a, c], abs=1e-7)


def test_whitening_widens_only_flat_spectra(spark, monkeypatch):
    shapes = []
    real = whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda rows, shape, *a: shapes.append(shape) or real(rows, shape, *a))
    rng = np.random.default_rng(2)
    for decay, wide in ((1.2, 12), (0.01, 40)):
        shapes.clear()
        data = rng.standard_normal((300, 40)) * 400 * np.exp(-decay * np.arange(40))
        whitening.whiten(spark.createDataFrame(vectors([(i, v.tolist()) for i, v in enumerate(data)]), VECTORS), components=6, oversampling=6, passes=6)
        assert max((s[0] - 1) // 40 for s in shapes[1:-1]) == wide


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None)], [(1, [2.0, 2.0])] * 5, [(1, [])]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(vectors(rows), VECTORS)).collect() == []


def test_whitening_of_ragged_and_large(spark):
    rows = [(None, [1.0]), (2, [3.0, 1.0]), (3, [1e30, -5.0]), (4, [])]
    got = whitening.whiten(spark.createDataFrame(vectors(rows), VECTORS)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 4  # the large entry's variance hides the other's
    assert sorted(str(r["vec_id"]) for r in got) == ["2", "3", "4", "None"]


def brute_cut(rows, width=50):
    """(id, text) after passages of ``width`` words that a smaller id has are gone; texts of which nothing is left go."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in rows]
    first = {}
    for d, w in words:
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            first[key] = min(d, first.get(key, d))
    out = []
    for (d, text), (_, w) in zip(rows, words):
        gone = {j for a in range(len(w) - width + 1) if first[tuple(w[a : a + width])] < d for j in range(a, a + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone or kept:
            out.append((d, kept if gone else text))
    return out


def test_pipeline_rows_are_brute_force(spark, tmp_path):
    """run()'s pieces are those of the texts that brute force leaves of what the language stage keeps, gaplessly packed."""
    import public_tokenizers as P
    import tokenizers

    import corpus_pipeline
    from tests.llm.test_brute_force import brute_one_of_each, texts

    shared = " ".join(f"passage{i}" for i in range(60))
    rows = list(enumerate(texts(90, seed=21), 1))
    rows += [(500 + d, t + " tail") for d, t in rows[:20]] + [(600 + k, f"{texts(1, seed=40 + k)[0]} {shared} end {k}") for k in range(5)] + [(700, None), (701, "12 !!"), (702, shared)]
    docs = [(d, t, "en" if d % 2 else "de", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = [(r["doc_id"], r["text"]) for r in corpus_pipeline.language_id(spark, table, "").collect()]
    assert {700, 701}.isdisjoint(d for d, _ in told) and len(told) > 100
    left = brute_cut(brute_one_of_each(told))
    assert len(left) < len(told) and sum(len(t.split()) for _, t in left) < sum(len(t.split()) for _, t in brute_one_of_each(told))
    encoder = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: [*encoder.encode(t, add_special_tokens=False).ids, 0] for d, t in left}
    assert max(map(len, ids.values())) <= 2048
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    assert got == sorted((d, 0, 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids.items())
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
