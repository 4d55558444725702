"""Operators of series that never end."""
