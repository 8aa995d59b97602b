"""Queries of the evidence-graph operators, each with its oracle."""

from __future__ import annotations

from strandmill.plans import evidence_discovery, evidence_graph, evidence_io, evidence_scoring, evidence_tables
from strandmill.plans.registry import Registry

REG = Registry()
for _part in (evidence_tables, evidence_scoring, evidence_discovery, evidence_graph, evidence_io):
    for _name, _query in _part.REG.queries.items():
        REG.query(_name, _part.REG.oracles.get(_name))(_query)
