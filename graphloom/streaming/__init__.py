"""Graphs that arrive as streams."""
