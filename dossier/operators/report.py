"""Report sheets: one DataFrame per section, written as CSV folders; a page of HTML for one claim."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

MOST_CELL = 32_000


def cell(value: Column) -> Column:
    """Text for a sheet: cut to what a cell holds, and never read as a formula."""
    text = F.substring(F.coalesce(value.cast("string"), F.lit("")), 1, MOST_CELL)
    return F.when(text.rlike(r"^[=+@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def sheet_names(titles: list[str]) -> list[str]:
    """At most 31 characters, without reserved ones, unique by number."""
    out: list[str] = []
    for title in titles:
        base = "".join(c for c in title if c not in "[]:*?/\\")[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in {n.lower() for n in out}:
            suffix = f" {k}"
            name, k = base[: 31 - len(suffix)] + suffix, k + 1
        out.append(name)
    return out


def write_sheets(sheets: dict[str, DataFrame], path: str) -> list[str]:
    """Writes each section; returns their folders."""
    names = sheet_names(list(sheets))
    for name, rows in zip(names, sheets.values(), strict=True):
        rows.select(*(cell(F.col(c)).alias(c) for c in rows.columns)).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return [f"{path}/{n}" for n in names]


def decisions(*kinds: DataFrame) -> DataFrame:
    """Human decisions of all kinds (at, kind, subject, note) in the order of time, kind and subject."""
    first, *rest = kinds
    for more in rest:
        first = first.unionByName(more)
    return first.orderBy("at", "kind", "subject")


def page(report: Row) -> str:
    """HTML of one claim's collected report (title, score, readiness, checklist)."""
    items = "".join(f"<tr><td>{html.escape(i['requirement'])}</td><td>{html.escape(i['state'])}</td></tr>" for i in report["checklist"])
    return f"<!DOCTYPE html><title>{html.escape(str(report['title']))}</title><h1>{html.escape(str(report['title']))}</h1><p>{report['score']}: {html.escape(report['readiness'])}</p><table>{items}</table>"
