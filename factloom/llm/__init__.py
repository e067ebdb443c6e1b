"""Operators for preparing training corpora: deduplication, filtering, tokenising, packing.

Nothing else in the library imports this subpackage; it stands on its own.
"""
