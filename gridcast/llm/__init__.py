"""Operators for preparing training data: near duplicates, tokens, quality, language, mixing, sharding."""
