"""Operators and queries of a training-data pipeline over the text tables."""
