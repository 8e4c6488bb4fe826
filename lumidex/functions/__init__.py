"""Scalar functions and patterns."""
