"""Queries over the library's operators, ready to run."""
