"""Registered queries of the ledger engine."""

from importlib import import_module

from ..plans.registry import ORACLES, QUERIES

MODULES = ("filters", "aggregates", "closeness", "joins", "windows", "functions", "mutations", "columns", "edges", "records", "retrieval", "sources", "spoken", "store", "streams")
for _m in MODULES:
    import_module(f".{_m}", __name__)

__all__ = ["ORACLES", "QUERIES"]
