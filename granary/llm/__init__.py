"""Training-data operators: extraction, filters, deduplication, tokenization, privacy.

Nothing else in the library imports this subpackage.
"""
