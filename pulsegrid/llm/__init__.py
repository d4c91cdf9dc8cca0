"""Operators on text, pages and vectors for building training data, with their queries."""
