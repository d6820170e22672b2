"""Operators for large text corpora: media payloads, deduplication, filtering, scoring, packing.

Nothing outside this subpackage imports it.
"""
