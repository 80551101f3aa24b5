"""Operators for preparing training text: fingerprints, classifiers, deduplication, tokens."""
