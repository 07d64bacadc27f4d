"""The same transformations over arriving data."""
