"""Training-data operators: deduplication, tokenising, mixing, extraction, scoring.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
