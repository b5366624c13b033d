"""Operators for large training corpora: cleaning, duplicates, mixing, packing, search, formatting."""
