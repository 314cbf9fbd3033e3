"""Operators for preparing large text corpora: scoring, packing, redaction, fingerprints, deduplication.

Nothing outside this subpackage imports it; see ``queries.py`` for the registered queries.
"""
