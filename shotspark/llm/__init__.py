"""Operators for training-data pipelines over documents, web pages and conversations."""
