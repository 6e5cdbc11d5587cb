"""Grouping, ranking and voting operators over any claim-shaped table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, key: str, members: str) -> DataFrame:
    """Keys that occur twice or more, with their count and smallest member."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(members).alias("first_member")).filter("n >= 2")


def originals_and_copies(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Adds place (1 is the original) and copies of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn(
        "copies", F.count("*").over(Window.partitionBy(key))
    )


def vote(candidates: DataFrame, *group: str) -> DataFrame:
    """One row per group and normalised value, ranked.

    candidates: normal (null cannot be compared), weight, eligible, confidence, source.  Weight counts
    eligible sources only; a group needs one to be chosen.  Order: weight, eligible sources, best
    eligible confidence, then the value.
    """
    tallied = (
        candidates.filter("normal is not null")
        .groupBy(*group, "normal")
        .agg(
            F.sum(F.when(F.col("eligible"), F.col("weight")).otherwise(0)).cast("bigint").alias("weight"),
            F.count_if("eligible").alias("n_eligible"),
            F.count("*").alias("n_sources"),
            F.max(F.when(F.col("eligible"), F.col("confidence"))).alias("confidence"),
        )
    )
    order = [F.desc(F.col("n_eligible") > 0), F.desc("weight"), F.desc("n_eligible"), F.desc_nulls_last("confidence"), F.asc("normal")]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return tallied.withColumn("rank", rank).withColumn("chosen", (F.col("rank") == 1) & (F.col("n_eligible") > 0))


def competing(voted: DataFrame, *group: str) -> DataFrame:
    """The values that lost, in the order of weight, sources and value."""
    order = Window.partitionBy(*group).orderBy(F.desc("weight"), F.desc("n_sources"), "normal")
    return voted.filter("not chosen").withColumn("place", F.row_number().over(order))


def wording(candidates: DataFrame, *group: str) -> DataFrame:
    """The wording printed most per group; ties go to the heavier document, then to the alphabet.  Ineligible ones count."""
    counted = candidates.groupBy(*group, "value").agg(F.count("*").alias("n"), F.max("weight").alias("heaviest"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.desc("heaviest"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank", "heaviest")


def marginals(rows: DataFrame, first: str, second: str, active: Column) -> DataFrame:
    """Counts by each column and in all, from one pass; the other column is null."""
    return rows.groupingSets([[F.col(first)], [F.col(second)], []], F.col(first), F.col(second)).agg(
        F.count("*").alias("n"), F.count_if(active).alias("n_active"), F.grouping_id().cast("bigint").alias("level")
    )


def zero_filled(domain: DataFrame, counts: DataFrame, on: str, *columns: str) -> DataFrame:
    """Counts over the full domain, absent ones as 0."""
    return domain.join(counts, on, "left").na.fill(0, list(columns))


def last_rows(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The last n rows of each key by a descending order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= n)
