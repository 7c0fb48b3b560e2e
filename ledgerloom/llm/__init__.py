"""Training-data operators (text extraction, filtering, tokenising, deduplication).

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
