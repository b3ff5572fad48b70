"""Operators for language-model training data: scoring, extraction, deduplication, filters, tokenizing."""
