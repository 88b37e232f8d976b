"""All queries of the library and their SQL."""

from factloom.queries import facts, items, more, nested, picks, plans, repairs, rows, samples, tallies, texts  # noqa: F401
from factloom.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
