"""Named queries over the given tables, each with the equal SQL where SQL can say it."""

from . import (aggregates, inputs, joins, modelling, plans, projections, scalars,  # noqa: F401
               windows)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
