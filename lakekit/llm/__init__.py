"""Operators for preparing training data, each with its own method, and the queries that apply them."""
