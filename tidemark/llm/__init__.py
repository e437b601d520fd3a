"""Operators of a training-data pipeline: packing, deduplication, scans, classifiers and scores."""
