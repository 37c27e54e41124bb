"""Operators for preparing text corpora: search, token counts, deduplication, packing, extraction.

Nothing outside this subpackage imports it.
"""
