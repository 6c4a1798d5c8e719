"""Operators for large-scale training text: each a function over DataFrames, and its query."""
