"""All registered queries of the library and the SQL each is held against."""

from __future__ import annotations

from terralith.plans import aggregates, audits, decision, formats, imports, intake, levels, records, resolution

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (decision, aggregates, resolution, imports, audits, records, intake, formats, levels):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
