"""Operators on run, node, edge and document tables."""
