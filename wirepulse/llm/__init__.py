"""Operators and queries for preparing training data."""
