"""Operators on edges, labels and block matrices; each takes and returns DataFrames."""
