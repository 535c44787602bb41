"""Corpus operators for training data: language, quality, dedup, contamination, tokens, search, secrets, licences, pages."""
