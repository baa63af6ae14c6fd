"""Sources of the lectern engine."""
