"""Every library query, of all modules."""

from __future__ import annotations

from quern.plans import collection, features, pages, registry, shapes

assert collection and features and pages and shapes  # imported for the queries that they register

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
