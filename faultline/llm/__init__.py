"""Operators for building training corpora: ten document operators and the queries that apply them."""
