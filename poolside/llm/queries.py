"""The numbered queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers

from poolside.llm.bm25 import search, search_sql
from poolside.llm.bpe import bpe_digests
from poolside.llm.common import table
from poolside.llm.html_extract import extract_main_text
from poolside.llm.license_scan import scan_digests, scan_sql
from poolside.llm.packing import pack
from poolside.llm.prefix_trie import conversation_trie
from poolside.llm.privacy import privacy_digests
from poolside.llm.webp import media_digests
from poolside.llm.language_id import language_predictions
from poolside.llm.simhash import simhash_classes
from poolside.llm.substring_dedup import dedup_digests
from poolside.llm.token_count import token_counts
from poolside.llm.whitening import whiten


def op1_bm25_search(spark, sf_dir):
    """Every document whose id is divisible by 20 asks, with its whole text, all documents."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.filter("doc_id % 20 = 0"))


def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_language_id(spark, sf_dir):
    return language_predictions(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash_classes(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_license_scan(spark, sf_dir):
    return scan_digests(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_html_extract(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_webp(spark, sf_dir):
    return media_digests(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return dedup_digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_privacy(spark, sf_dir):
    return privacy_digests(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bm25_search, op2_token_counts, op3_language_id, op4_simhash, op5_bpe, op6_license_scan, op7_packing, op8_html_extract, op9_webp, op10_substring_dedup,
        op11_prefix_trie, op12_privacy, op13_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_bm25_search": search_sql(), "op6_license_scan": scan_sql()}
