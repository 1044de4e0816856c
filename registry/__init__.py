"""Every operator and job as a query over the given tables, with its DuckDB text."""

import importlib

SECTIONS = ("sources", "clean", "shapes", "panels", "fills", "models", "jobs")


def load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"registry.{section}")
