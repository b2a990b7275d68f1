"""Operators for preparing training text: archives, languages, quality, mixing, duplicates, extraction, secrets, benchmarks."""
