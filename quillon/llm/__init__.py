"""Training-data operators: filters, deduplication, mixing and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
