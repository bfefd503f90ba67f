"""Training-data operators: dedup, scoring, privacy, extraction, filters and tokenizers.

Nothing outside this subpackage imports it.
"""
