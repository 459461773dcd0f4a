"""Whole fits: the search, the sequential kernel, the driver loops and the query catalogue."""
