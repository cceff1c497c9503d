"""Operators for building training corpora: deduplication, decontamination, tokenizing, sharding and filters.

Nothing else in the library imports this subpackage.
"""
