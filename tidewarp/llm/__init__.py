"""Operators for training-data pipelines: tokenising, packing, extraction, deduplication, scoring, search, archives.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it is present.
"""
