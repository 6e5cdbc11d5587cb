"""Typed values and bills from text lines."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import snippet
from dossier.functions.values import comparison


@dataclass(frozen=True)
class Spec:
    """A field, its kind, and the labels (patterns) it is printed under, best first."""

    key: str
    kind: str
    labels: tuple[str, ...]


def fields(spark: SparkSession, lines: DataFrame, specs: list[Spec]) -> DataFrame:
    """doc, key, value, normal, page, line, evidence, confidence: per field the best label, then page, then line, that can be read.

    lines: doc, page, line, text, source (text or ocr), ocr_confidence.  A line is split into cells at wide gaps,
    bullets and bars.  A cell is a label up to its first separator and a value behind it; a label without a
    value takes the next cell, unless that has a label of its own.  Specs are a small fixed list: they are
    exploded as literals, so nothing is joined.
    """
    cells = F.filter(F.split("text", r"\s\s+|\s*[·•|]\s*"), lambda c: F.trim(c) != "")
    cut = F.transform(cells, lambda c: F.struct(c.alias("cell"), F.split(c, r"\s*[:\-–]\s*", 2).alias("halves")))
    seen = lines.withColumn("cells", cut).withColumn("at", F.explode(F.expr("sequence(0, greatest(size(cells) - 1, 0))")))
    own, following = F.get("cells", F.col("at")), F.get("cells", F.col("at") + 1)
    value = F.trim(F.get(own.halves, F.lit(1)))
    value = F.when(value != "", value).when((value == "") & (F.size(following.halves) == 1), F.trim(following.cell))
    seen = seen.select("doc", "page", "line", "text", "source", "ocr_confidence", "at", own.cell.alias("cell"), F.trim(F.get(own.halves, F.lit(0))).alias("label"), value.alias("value"))
    seen = seen.filter("value is not null")
    found = [
        F.when(F.col("label").rlike(f"(?i)^(?:{label})$"), F.struct(F.lit(spec.key).alias("key"), F.lit(spec.kind).alias("kind"), F.lit(rank).alias("rank")))
        for spec in specs for rank, label in enumerate(spec.labels)
    ]
    rows = seen.withColumn("f", F.explode(F.array_compact(F.array(*found)))).select("doc", "page", "line", "text", "source", "ocr_confidence", "at", "cell", "value", "f.*")
    rows = rows.withColumn("normal", comparison(F.col("kind"), F.col("value"))).filter("normal is not null")
    first = F.row_number().over(Window.partitionBy("doc", "key").orderBy("rank", "page", "line", "at"))
    begin = F.expr("locate(value, text, locate(cell, text)) - 1")
    confidence = F.when(F.col("source") == "ocr", F.bround(F.least(F.lit(0.9), F.coalesce(F.nullif(F.col("ocr_confidence"), F.lit(0.0)), F.lit(0.7))), 4)).otherwise(0.95)
    best = rows.withColumn("place", first).filter("place = 1")
    return best.select("doc", "key", "value", "normal", "page", "line", snippet(F.col("text"), begin, begin + F.length("value")).alias("evidence"), confidence.alias("confidence"))


BILL = "doc long, line long, description string, quantity string, rate string, amount string, kind string"


def bills(lines: DataFrame) -> DataFrame:
    """Bill rows and totals of documents: one state machine per document over its ordered lines.

    lines: doc, page, line, text with wide gaps of two spaces.  A header of three cells or more with a
    description and an amount opens a table; numbered rows belong to it; of each kind of total the first counts.
    """
    totals = {"subtotal": "subtotal", "sub total": "subtotal", "tax": "tax", "gst": "tax", "discount": "discount", "total": "total", "grand total": "total", "net amount": "total"}

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        out, columns, seen = [], None, set()
        for row in frame.sort_values(["page", "line"]).itertuples():
            cells = [c.strip() for c in (row.text or "").split("  ") if c.strip()]
            lowered = [c.lower() for c in cells]
            if len(cells) >= 3 and any("description" in c or "particulars" in c for c in lowered) and any("amount" in c for c in lowered) and len(set(lowered)) == len(lowered):
                columns = lowered
                continue
            name = lowered[0].rstrip(":") if cells else ""
            if name in totals and len(cells) == 2:
                if totals[name] not in seen:
                    seen.add(totals[name])
                    out.append((row.doc, row.line, cells[0], None, None, cells[1], totals[name]))
                continue
            if columns and cells and cells[0].rstrip(".").isdigit() and len(cells) == len(columns):
                by = dict(zip(columns, cells, strict=True))
                get = lambda *keys: next((v for k, v in by.items() if any(x in k for x in keys)), None)  # noqa: E731, B023
                out.append((row.doc, row.line, get("description", "particulars"), get("qty", "quantity"), get("rate", "price"), get("amount"), "line"))
        return pd.DataFrame(out, columns=["doc", "line", "description", "quantity", "rate", "amount", "kind"])

    return lines.groupBy("doc").applyInPandas(read, BILL)
