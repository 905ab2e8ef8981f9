"""All workload queries by key."""

from __future__ import annotations

from stmtlens.plans import basic, crossdb, ctes, edge, procedures, realworld, subqueries, windows

QUERIES = {
    **basic.QUERIES,
    **ctes.QUERIES,
    **subqueries.QUERIES,
    **windows.QUERIES,
    **procedures.QUERIES,
    **crossdb.QUERIES,
    **edge.QUERIES,
    **realworld.QUERIES,
}
