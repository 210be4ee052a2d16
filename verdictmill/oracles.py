"""The SQL that each registered query must agree with, by the query's name."""

from . import plans  # noqa: F401
from .plans.registry import SQL

__all__ = ["SQL"]
