"""Layout of the words of printed bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import layout
from dossier.plans.paper import _ROWS, printed_bills


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the printed bills as text lines, with wide gaps between columns."""
    words = printed_bills(spark, sf_dir).filter("line between 1 and 3")
    rows = words.select((F.col("doc") * 1000 + F.col("page")).alias("page"), "text", "left", "right", (F.col("line") * 14.0).alias("baseline"))
    return layout.lines(rows).select("page", F.regexp_count("text", F.lit("  ")).cast("bigint").alias("n_gaps"), F.regexp_replace("text", " +", " ").alias("text"))


TEXT_LINES = f"""
WITH {_ROWS}
SELECT doc * 1000 + (rank - 1) // 3 + 1 AS page, CAST(4 AS BIGINT) AS n_gaps, rank || CASE rank % 2 WHEN 0 THEN '.' ELSE '' END || ' ' || description || ' ' || quantity || ' ' || __RATE__ || ' ' || __AMOUNT__ AS text FROM r
"""


def _sql() -> str:
    from dossier.plans.paper import _grouped

    return TEXT_LINES.replace("__RATE__", _grouped("rate")).replace("__AMOUNT__", _grouped("amount"))


CATALOGUE = {"text_lines": (text_lines, _sql())}
