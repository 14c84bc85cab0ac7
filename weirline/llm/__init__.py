"""Operators of a training-data pipeline: deduplication, filtering,
extraction, decontamination, tokenisation, scoring and exact search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
