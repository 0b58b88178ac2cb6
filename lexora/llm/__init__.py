"""Operators for large training-text corpora, one module each.

Nothing outside this package imports it.
"""
