"""Streaming of the lectern engine."""
