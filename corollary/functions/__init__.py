"""Set operations and helpers."""
