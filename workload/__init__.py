"""Registered queries: every operator on the given tables, with SQL beside it."""

from __future__ import annotations

import importlib

MODULES = ("matrix", "extraction", "cleaning", "auditing", "scoring", "text", "metadata", "receptors",
           "rules", "sampling", "clusters", "summaries", "genes", "jobs", "files")


def load_all():
    """(queries, oracle SQL), from every module of this package."""
    from workload import base

    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return base.QUERIES, base.ORACLE
