"""Operators on tables of linear systems."""
