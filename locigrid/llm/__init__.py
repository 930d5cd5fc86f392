"""Operators of a training-data pipeline: quality, search, duplicates, secrets, archives, mixing, packing."""
