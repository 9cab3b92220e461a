"""Scalar predicates and helpers: JSON model, URIs, regular expressions, formats."""
