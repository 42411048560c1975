"""Spark jobs for robust portfolio decisions on tabular data."""
