"""Every registered query, by section."""

from paritas.catalog import campaign, decoding, incidence, plans, selection, statistics, streams
from paritas.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "campaign", "decoding", "incidence", "plans", "selection", "statistics", "streams"]
