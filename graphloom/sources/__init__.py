"""Readers of graph files and tables, and writers of results."""
