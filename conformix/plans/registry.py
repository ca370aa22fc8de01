"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from conformix.plans import queries_assessment, queries_candidates, queries_drawings, queries_evidence, queries_mapping, queries_normalize, queries_reports, queries_requirements, queries_rules, queries_runs, queries_stores, queries_text

_MODULES = (queries_drawings, queries_normalize, queries_evidence, queries_mapping, queries_assessment, queries_rules, queries_text, queries_requirements, queries_candidates, queries_reports, queries_runs, queries_stores)

QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
