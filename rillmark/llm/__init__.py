"""Operators for preparing training corpora: deduplication, scoring, tokens, mixing, storage.

Nothing outside this subpackage imports it; it imports nothing of the rest.
"""
