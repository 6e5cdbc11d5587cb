"""Names of the library's queries, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _catalogue() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from dossier.plans import canonical, checks, claims, documents, functions, literals, pages, paper, publishing, records, relations, roundtrips, sections, streams, workflow

    found: dict[str, tuple] = {}
    for module in (documents, claims, checks, workflow, functions, literals, records, roundtrips, sections, canonical, streams, paper, publishing, pages, relations):
        for name, item in module.CATALOGUE.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = item
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}
