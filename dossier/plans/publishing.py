"""Queries over what has been published in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.values import MONEY
from dossier.operators import reanalysis
from dossier.sources.publish import Published
from dossier.sources.tables import table
from dossier.streaming.events import folder


def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders published in two versions: the second holds those that changed, and takes those of one priority away."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    store = Published(spark, folder(spark, "published"), "o_orderkey", "payload")
    store.publish(orders.select("o_orderkey", F.col("o_orderstatus").alias("payload")))
    later = F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus"))
    store.publish(orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", later).alias("payload")))
    return store.current().select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "payload", "version")


PUBLISHED_VERSIONS = """
SELECT o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN '!' ELSE '' END AS payload, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version
FROM orders WHERE o_orderpriority <> '5-LOW'
"""


def _bill(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast(MONEY)
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(price).cast("string").alias("total"), F.min("l_shipdate").cast("date").cast("string").alias("first"))


def reanalysed_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills after a second pass: the first saw no returned line and some lines that are gone; the second computes what changed."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    store = Published(spark, folder(spark, "reanalysed"), "l_orderkey", "payload")
    gone = lines.limit(50).withColumn("l_orderkey", -F.col("l_orderkey") - 1)
    reanalysis.refresh(lines.filter("l_returnflag <> 'R'").unionByName(gone), store, _bill)
    reanalysis.refresh(lines, store, _bill)
    found = reanalysis.result(store, "n bigint, total string, first string")
    return found.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), "n", "total", "first")


REANALYSED_BILLS = """
SELECT l_orderkey, count(*) AS n, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS VARCHAR) AS total, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS "first" FROM lineitem GROUP BY 1
"""

CATALOGUE = {
    "published_versions": (published_versions, PUBLISHED_VERSIONS),
    "reanalysed_bills": (reanalysed_bills, REANALYSED_BILLS),
}
