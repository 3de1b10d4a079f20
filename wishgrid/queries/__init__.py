"""Registered queries: every operator over the shared tables, with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

from wishgrid.queries.registry import ORACLES, QUERIES

FAMILIES = ("geo", "facts", "listings", "catalog", "poi", "shortlist", "text", "wishes", "matching", "audit", "merge", "stream", "scalars")

for _family in FAMILIES:
    try:
        import_module(f"wishgrid.queries.{_family}")
    except ModuleNotFoundError as missing:
        if missing.name != f"wishgrid.queries.{_family}":
            raise

__all__ = ["ORACLES", "QUERIES"]
