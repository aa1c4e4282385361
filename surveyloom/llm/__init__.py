"""Operators of a training-data pipeline: token files, archives, duplicates, packing, quality."""
