"""Resolve, rank and track records that arrive from many overlapping sources, on Spark."""

__version__ = "0.1.0"
