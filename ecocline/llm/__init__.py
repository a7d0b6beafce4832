"""Operators for preparing training data: duplicates, search, packing, filters and mixing."""
