"""Operators for preparing training text: dedup, search, mixing, filters, archives, packing."""
