"""Registered queries of the reconciliation engine."""

from __future__ import annotations

from pairwright.plans import cycle, linkage, merge, state, wire

QUERIES: dict = {**merge.QUERIES, **linkage.QUERIES, **state.QUERIES, **wire.QUERIES, **cycle.QUERIES}
ORACLE: dict[str, str] = {**merge.ORACLE, **linkage.ORACLE, **state.ORACLE, **wire.ORACLE}
