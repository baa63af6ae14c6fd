"""Plans of the lectern engine."""
