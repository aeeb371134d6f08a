"""All registered queries of the spatial engine and the SQL that checks them."""

from __future__ import annotations

from . import evaluating, frames, generating, geometry, relational, storing

QUERIES: dict = {}
ORACLE_SQL: dict = {}

for _module in (geometry, generating, relational, evaluating, frames, storing):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
