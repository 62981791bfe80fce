"""A PySpark engine for keyed, continuously aggregated data."""
