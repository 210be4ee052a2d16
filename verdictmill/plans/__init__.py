"""The registered queries over the given tables, by family."""

from . import analysis, conversations, gates, governance, inference, ledgers, records, scorecards, screening, texts  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
