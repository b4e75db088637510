"""Operators for preparing text corpora: quality, duplicates, mixing, tokens and packing."""
