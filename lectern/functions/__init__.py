"""Functions of the lectern engine."""
