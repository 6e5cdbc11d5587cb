"""Claim-shaped views over the input tables, as SURVEY lists them: orders are claims, line items documents and bill lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.values import MONEY
from dossier.sources.tables import table


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("stated_on"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast(MONEY).alias("total"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of claims; the type is the pair of flags.  (claim, line) is not a key."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return lines.select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("doc_type"),
        F.col("l_shipdate").cast("date").alias("dated"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("party"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
    )


def bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quantity, rate and amount as money.  The part list is a dimension: its join strategy is left to its size."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_retailprice")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("description"),
        F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("p_retailprice").cast(MONEY).alias("rate"), F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_discount").cast(MONEY).alias("discount"), F.col("l_tax").cast(MONEY).alias("tax"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
