"""Operators on vectors and texts for training-data pipelines. Nothing outside of this package imports it."""
