"""Operators of a training-data pipeline: identification, deduplication, decontamination, tokens, scores, filters."""
