"""Operators for large text corpora: tokens, duplicates, languages, quality and leaks.

Nothing outside this package imports it, so it can be removed as a whole.
"""
