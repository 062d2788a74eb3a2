"""Training-data operators: tokenising, media, WARC, near-dedup, scoring and filtering.

Nothing else in the library imports this subpackage.
"""
