"""Column-level helpers: exact decimal rounding, date keys, text formatting."""
