"""Operators of a training-data pipeline: token stores, search, duplicates, quality, packing,
mixing, personal data and language. Nothing outside this subpackage imports it."""
