"""Registered queries: every operator over the given tables, with its SQL counterpart."""

from hiremill.catalog import discovery, filters, ledgers, pages, reports, streams, texts
from hiremill.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "discovery", "filters", "ledgers", "pages", "reports", "streams", "texts"]
