"""Every runnable query, and the SQL it is checked against."""

from tallybook.catalog.base import ORACLE, QUERIES
from tallybook.catalog import derivations, erp, folders, landing, maintenance, operations, store, streams, supply  # noqa: F401
from tallybook.catalog import ranked  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
