"""Registered queries of the reference's operators and the SQL that each must agree with."""

from . import derive, identity, review, rules, scalars, sets, sources, timelines  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
