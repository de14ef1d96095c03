"""Operators on transaction tables."""
