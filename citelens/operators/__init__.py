"""Operators on citation, text, vector and report tables."""
