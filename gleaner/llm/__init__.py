"""Operators of a training-data pipeline: near-duplicates, quality, tokens, packing and mixing."""
