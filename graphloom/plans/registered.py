"""All registered queries; importing a module of queries registers them."""

from __future__ import annotations

from . import archives, audits, documents, exchange, times  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
