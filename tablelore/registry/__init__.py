"""Named queries over the test tables, each with equivalent SQL where SQL can say it."""

from .base import Query, all_queries

__all__ = ["Query", "all_queries"]
