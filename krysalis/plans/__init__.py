"""Queries composed of operators, and their SQL."""
