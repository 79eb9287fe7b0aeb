"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from probelake.plans import evaluations, scans, stand_ins

FLAGSHIP = "set_metrics_by_customer"
#: ``evaluations`` and ``scans`` add their own queries to these tables.
QUERIES = stand_ins.QUERIES
ORACLE_SQL = stand_ins.ORACLE_SQL
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "evaluations", "scans"]
