"""Operators on the text corpus for training data."""
