"""Operators of a training-data pipeline: ten operators over texts and conversations."""
