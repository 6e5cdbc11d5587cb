"""Scalar functions over columns of the tables, with SQL of its own for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import report
from dossier.sources.tables import table

ASKED = {"greeting": ("hello", "hallo"), "article": ("the ", "der ", "le "), "list": (";", ":")}
BANNED = ["and", "und", "et"]


def _texts(name: str, function):
    """A query that applies a function to every whole document text and returns its digest and length."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", function(F.col("text")).alias("v"))
        return rows.select("doc_id", F.md5(F.col("v").cast("binary")).alias("digest"), F.length("v").cast("bigint").alias("size"))

    run.__name__ = run.__qualname__ = name
    return run


def _digests(value: str) -> str:
    return f"SELECT doc_id, md5(v) AS digest, length(v) AS size FROM (SELECT doc_id, {value} AS v FROM documents)"


def plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer in words."""
    return table(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", T.plural(F.col("n"), "entry", "entries").alias("said"))


def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of each type of part in words."""
    return table(spark, sf_dir, "part", "p_type", "p_brand").groupBy("p_type").agg(T.names(F.collect_set("p_brand")).alias("brands"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names of page addresses, cut to 12 characters before the extension."""
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.file_name(F.concat("url", F.lit(".html")), 12).alias("name"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group of words that a text holds one of."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.intent(F.col("text"), ASKED).alias("intent"))


FILE_NAMES = """
SELECT page_id, CASE WHEN length(b) > 12 THEN left(b, 12 - length(d)) || d ELSE b END AS name
FROM (SELECT page_id, b, regexp_extract(b, '[.][^.]{1,16}$') AS d FROM (SELECT page_id, regexp_extract(url || '.html', '[^/]*$') AS b FROM pages))
"""
NAME_LISTS = """
SELECT p_type, CASE len(b) WHEN 1 THEN b[1] ELSE array_to_string(b[1 : len(b) - 1], ', ') || ' and ' || b[len(b)] END AS brands
FROM (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS b FROM part GROUP BY p_type)
"""
INTENTS = """
SELECT doc_id, CASE WHEN contains(t, 'hello') OR contains(t, 'hallo') THEN 'greeting' WHEN contains(t, 'the ') OR contains(t, 'der ') OR contains(t, 'le ') THEN 'article'
  WHEN contains(t, ';') OR contains(t, ':') THEN 'list' ELSE 'unknown' END AS intent FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
"""

CATALOGUE = {
    "clean_text": (_texts("clean_text", T.clean), _digests("trim(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '[,;:.\\-–—]+$', ''))")),
    "squashed": (_texts("squashed", T.squash), _digests("trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))")),
    "scrubs": (
        _texts("scrubs", lambda c: T.scrub(c, BANNED)),
        _digests("array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: NOT regexp_matches(lower(s), '(^|[^\\p{L}\\p{N}_])(and|und|et)($|[^\\p{L}\\p{N}_])')), ' ')"),
    ),
    "snippets": (_texts("snippets", lambda c: T.snippet(T.text(c), F.lit(30), F.lit(35))), _digests("left(regexp_replace(trim(substring(coalesce(text, ''), 3, 61)), '\\s\\s+', ' · ', 'g'), 90)")),
    "sheet_cells": (_texts("sheet_cells", lambda c: report.cell(F.concat(F.when(F.length(T.text(c)) % 3 == 0, "=").otherwise(""), T.text(c)))),
        _digests("CASE WHEN regexp_matches(c, '^[=+@\\t\\r]') THEN chr(39) || left(c, 32000) ELSE left(c, 32000) END").replace("FROM documents", "FROM (SELECT doc_id, CASE length(coalesce(text, '')) % 3 WHEN 0 THEN '=' ELSE '' END || coalesce(text, '') AS c FROM documents)")),
    "plurals": (plurals, "SELECT o_custkey, n || CASE n WHEN 1 THEN ' entry' ELSE ' entries' END AS said FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"),
    "name_lists": (name_lists, NAME_LISTS),
    "file_names": (file_names, FILE_NAMES),
    "intents": (intents, INTENTS),
}
