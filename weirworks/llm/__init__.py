"""Operators for preparing training text: cleaning, deduplication, tokenising, archiving and search."""
