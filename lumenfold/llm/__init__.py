"""Operators for preparing training data: deduplication, filters, scoring, decontamination and mixing.

Nothing else in the library imports this subpackage.
"""
