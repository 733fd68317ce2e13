"""Operators for preparing training data: survivors, nearest records, packing, mixing, text statistics."""
