"""Every operator as a query over the shared tables, with the equivalent SQL where SQL can say it."""

from confluo.checks import (  # noqa: F401
    aggregates,
    feeds,
    joins,
    predicates,
    ranking,
    resolution,
    scalars,
    streams,
)
from confluo.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
