"""Registered queries, one module per area; each has `CASES`: name -> (query, oracle SQL or None)."""

from importlib import import_module

MODULES = ["evaluation", "annotations", "geometry", "records", "streams"]


def all_cases() -> dict:
    cases: dict = {}
    for name in MODULES:
        for key, case in import_module(f"masklake.catalog.{name}").CASES.items():
            if key in cases:
                raise ValueError(f"query registered twice: {key}")
            cases[key] = case
    return cases
