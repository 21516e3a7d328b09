"""Training-data operators: tokenisation, deduplication, decontamination, scoring, archives.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
