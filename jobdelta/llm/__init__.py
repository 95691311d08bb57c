"""Operators that prepare text for training: scoring, de-duplication, tokenising and packing of documents."""
