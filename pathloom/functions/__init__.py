"""Scalar building blocks: query parsing, predicates, path and name expressions."""
