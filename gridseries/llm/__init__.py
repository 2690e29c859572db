"""Operators of a training-data pipeline: filtering, deduplication, redaction and mixing of text."""
