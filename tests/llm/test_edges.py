"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import time
import zlib
from pathlib import Path

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolside.llm import bm25, bpe, common, html_extract, language_id, license_scan, packing, simhash, substring_dedup, token_count, webp

LONG = "wort und satz mit wörtern " * 20_000
ROWS = [
    (1, "the cat sat on the mat and it was a good day for all", "en", None, 3),
    (1, "the cat sat on the mat and it was a good day for all", "en", None, 3),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \t\n ", "en", "s", 4),
    (None, "the dog ran in the park and it was fun for us", "en", "s", 5),
    (5, LONG, "de", "s", len(LONG)),
    (6, LONG, "de", "s", len(LONG)),
    (7, "x" * 30_000 + " é中\U0001f600 12345 !!! %%%", "de", "s", 9),
    (8, "12 34 !!", None, "s", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "row", "key", "score", "lang_pred", "fp", "host", "media", "kept", "term", "rank", "length", "spans"]


def frame(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("other") for c in CLASH})


def operators(df, id_col="doc_id"):
    ranks = P.path("byte_bpe_50k.tiktoken")
    return {
        "bm25": lambda: bm25.search(df, df),
        "tokens": lambda: token_count.token_counts(df, P.path("piece_bpe_32k.model")),
        "language": lambda: language_id.language_predictions(df, epochs=1),
        "simhash": lambda: simhash.simhash_classes(df),
        "one_of_each": lambda: simhash.one_of_each(df),
        "bpe": lambda: bpe.bpe_digests(df, ranks, P.PATTERN),
        "licence": lambda: license_scan.scan_digests(df),
        "packing": lambda: packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN),
        "html": lambda: html_extract.extract_main_text(df, "doc_id", "source", "text"),
        "webp": lambda: webp.media_digests(df),
        "dedup": lambda: substring_dedup.dedup_digests(df),
        "dedup_texts": lambda: substring_dedup.substring_dedup(df),
    }


ONE_EACH = ("tokens", "language", "simhash", "bpe", "licence", "html", "webp", "dedup", "dedup_texts")


@pytest.mark.parametrize("name", operators(None))
def test_edge_rows(spark, name):
    rows = operators(frame(spark, ROWS))[name]().collect()
    if name in ONE_EACH:
        assert len(rows) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", operators(None))
def test_empty_table(spark, name):
    assert operators(frame(spark, []))[name]().collect() == []


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
    kept = [r["doc_id"] for r in docs.collect()]
    assert sorted(x for x in kept if x is not None) == ([1, 5, 7] if rows else [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(kept)


def test_steps_remove_what_earlier_ones_staged(spark, tmp_path):
    """A step's tables go when another begins with rows that don't read them, and only those."""
    def here(df):
        return {Path(f.removeprefix("file:")).parent for f in df.inputFiles()}

    docs = frame(spark, ROWS)
    with common.pipeline_step(docs):
        first = common.staged(docs)
    outside = common.staged(docs)
    with common.pipeline_step(first):
        second = common.staged(first)
    assert first.count() == second.count() == outside.count() == len(ROWS)
    gone = here(first) | here(second)
    assert all(f.exists() for f in gone)
    outside.write.parquet(f"{tmp_path}/out.parquet")
    with common.pipeline_step(spark.read.parquet(f"{tmp_path}/out.parquet")):
        pass
    assert not any(f.exists() for f in gone) and outside.count() == len(ROWS)


OWN = ["score", "lang_pred", "_kept", "_id", "_whole", "_row", "changed", "Kept", "fp", "row"]


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "the cat sat on the mat and it was good", "en", None, 99), (2, " ".join(f"w{i}" for i in range(80)), "en", None, 98), (3, "head " + " ".join(f"w{i}" for i in range(80)), "en", None, 97)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in OWN})
    n_chars = {1: 99, 2: 98, 3: 4}  # only a text that lost words is counted anew
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "").collect()
        assert got and got[0].asDict().keys() == set(docs.columns), name
        for r in got:
            assert [r[c] for c in OWN] == [f"{c}{r['doc_id']}" for c in OWN]
            assert r["n_chars"] == (n_chars if name == "passage_dedup" else {1: 99, 2: 98, 3: 97})[r["doc_id"]]


VALUES = {
    "language": lambda r: (r["lang_pred"], r["score"]) == ("und", 0.0),
    "simhash": lambda r: (r["fingerprint"], r["component_id"]) == ("0" * 16, 2),
    "bpe": lambda r: r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest(),
    "tokens": lambda r: (r["n_words"], r["n_tokens"]) == (0, 0),
    "licence": lambda r: (r["n_sentences"], r["licences"]) == (0, ""),
    "webp": lambda r: (r["n_bytes"], r["payload_bytes"]) == (len(r["text"]), 64),
    "dedup": lambda r: (r["n_words"], r["n_removed"], r["kept_sha256"]) == (0, 0, hashlib.sha256(b"").hexdigest()),
    "html": lambda r: (r["text"], r["n_chars"]) == ("", 0),
}


@pytest.mark.parametrize("name", VALUES)
def test_values_of_blank_texts(spark, name):
    """Null, empty and white texts, of which no word is read."""
    rows = [(2, None), (3, ""), (4, " \t\n ")]
    df = frame(spark, [(*r, None, None, None) for r in rows])
    got = {r["doc_id"]: r.asDict() for r in operators(df)[name]().collect()}
    for d, text in rows:
        assert VALUES[name]({"text": text or ""} | ({k: v for k, v in got[d].items() if k != "text" or name == "html"})), (name, d)


def test_values_of_searches_and_packing(spark):
    """Copies tie and come by id, each as often as it is there; blank texts are one end id."""
    df = frame(spark, ROWS)
    found = bm25.search(df, df, k=20).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in found if r["query_id"] == 5) == [(1, 5), (2, 6)]
    ones = sorted((r["rank"], r["doc_id"]) for r in found if r["query_id"] == 1)
    assert ones == [(1, 1), (1, 1), (2, 1), (2, 1)]
    assert not {r["query_id"] for r in found} & {2, 3, 4, None}
    packed = [r for r in packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect() if r["doc_id"] in (2, 3)]
    assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed] == [(0, 0, 1, zlib.crc32(bytes(4)))] * 2


def shuffled_files(spark):
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_dedup_leaves_two_tables_and_no_shuffles(spark):
    text = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(1, text), (2, "x " + text), (3, "y")], "doc_id long, text string")
    root = Path(common.shared_dir(spark).removeprefix("file:"))
    before, shuffled = set(root.glob("staged-*")), shuffled_files(spark)
    out = substring_dedup.dedup_digests(df)
    left = set(root.glob("staged-*")) - before
    assert len(left) == 2, left  # decisions and hit
    for _ in range(100):  # Spark removes them in the background
        if not (more := shuffled_files(spark) - shuffled):
            break
        time.sleep(0.1)
    assert not more
    assert sorted((r["doc_id"], r["n_removed"]) for r in out.collect()) == [(1, 0), (2, 90), (3, 0)]
    assert spark.conf.get(common.CLEANUP) == "false"
