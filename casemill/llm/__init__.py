"""Operators for training-data pipelines; each module states its method and its results for odd input."""
