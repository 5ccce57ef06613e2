"""Operators for preparing training data: fingerprints, language, near-duplicates, secrets, personal data, mixing, tokens."""
