"""Operators for large text corpora: scoring, cleaning, packing and storage of training data."""
