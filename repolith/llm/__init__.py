"""Training-data operators: deduplication, filters, mixing, search and tokenisation.

Nothing else in the library imports this subpackage.
"""
