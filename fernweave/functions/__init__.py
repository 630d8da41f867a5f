"""Scalar functions on columns, and the sequential text operators."""
