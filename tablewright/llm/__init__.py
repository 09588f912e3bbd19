"""Operators for preparing text, vectors and web pages as training data for language models."""
