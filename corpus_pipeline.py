"""From documents to packed sequences: language ID, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame,
which is written as Parquet and read again before the next stage is called, as that removes the tables that stages
before it have staged for themselves (``pipeline_step``). All but the last return the columns of documents, and
columns of any other name as they are. Null and empty texts have no letter and go with the first stage; rows whose id is null
are compared with no other and stay; of repeated rows one stays; very long texts are read whole, and cut into
several pieces by the last stage only. Of an empty table nothing comes out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolside.llm.common import free_name, pipeline_step, staged, table
from poolside.llm.language_id import detect_languages, held_out, train_language_model
from poolside.llm.packing import pack
from poolside.llm.simhash import one_of_each
from poolside.llm.substring_dedup import substring_dedup

#: A text whose best language has less than this share of its positions is in none of the languages learned.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or in none of the languages that the others are labelled with."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    with pipeline_step(docs):
        model = train_language_model(docs.filter(~held_out()))
        kept = detect_languages(docs, model, lang_name=lang, score_name=score).filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates (7 bits of fingerprints of words, and five-word shingles alike by 0.8 or more): that of the smallest id, then text hash, then row."""
    with pipeline_step(docs):
        return one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; documents of which nothing is left go."""
    changed = free_name(docs, "changed")
    with pipeline_step(docs):
        cut = substring_dedup(docs, changed=changed)
    kept = cut.filter(~(F.col(changed) & (F.col("text") == "")) | F.col("text").isNull())
    return kept.withColumn("n_chars", F.when(F.col(changed), F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    with pipeline_step(docs):
        return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packing)]

#: SQL can't express the network, the classes' closure and the packing. Tests hold run()'s rows against brute force on what the language stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
