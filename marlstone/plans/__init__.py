"""Queries over the driver's tables, one module per family of operators."""

from __future__ import annotations

from . import aggregates, curation_plans, document_plans, endpoint_plans, expressions, flow_plans, matching, split_plans, windows

MODULES = (curation_plans, aggregates, document_plans, endpoint_plans, expressions, flow_plans, matching, split_plans, windows)


def queries():
    return {k: f for m in MODULES for k, f in m.plans.queries.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.plans.sql.items()}
