"""Operators that prepare records for training language models."""
