"""Operators of the lectern engine."""
