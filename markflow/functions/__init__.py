"""Scalar functions as Column expressions, and the small parsers that build them."""
