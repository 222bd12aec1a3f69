"""Training-data operators: scoring, filtering, deduplication, mixing and packing of documents.

Nothing outside this subpackage imports it.
"""
