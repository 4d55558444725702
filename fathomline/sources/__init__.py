"""Readers of the text formats of observations."""
