"""Operators for training-data pipelines over documents and conversations."""
