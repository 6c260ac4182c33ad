"""Operators on data that arrive in pieces."""
