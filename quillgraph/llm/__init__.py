"""Training-data operators: counting, formatting, cleaning, deduplication, scoring and packing of corpora.

Nothing outside this subpackage imports it.
"""
