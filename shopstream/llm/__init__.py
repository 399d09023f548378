"""Operators of a training-data pipeline: filters, near-duplicates, decontamination, tokens.

Nothing else in the library imports this package; it may be deleted as a whole.
"""
