"""Keyed state: reconciliation, question plans, differences and readiness as joins over immutable versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("open", "reopened")


def reconcile(stored: DataFrame, raised: DataFrame, key: str, inputs_changed: Column) -> DataFrame:
    """Next version of findings: key, status, occurrences, change.

    New ones open; those raised again keep a human decision, count up only if inputs changed, and reopen
    if they had been closed automatically; active ones no longer raised close automatically.
    """
    new = raised.select(key).distinct().withColumn("raised", F.lit(True))
    both = stored.select(key, "status", "occurrences").join(new, key, "full_outer").withColumn("raised", F.coalesce("raised", F.lit(False)))
    known = F.col("status").isNotNull()
    change = (
        F.when(~known, "created").when(F.col("raised") & (F.col("status") == "auto_closed"), "reopened")
        .when(~F.col("raised") & F.col("status").isin(*ACTIVE), "auto_closed").otherwise("kept")
    )
    status = F.when(change == "created", "open").when(change == "kept", F.col("status")).otherwise(change)
    more = F.when(F.col("raised") & known & inputs_changed, 1).otherwise(0)
    return both.select(key, status.alias("status"), (F.coalesce("occurrences", F.lit(1)) + more).cast("bigint").alias("occurrences"), change.alias("change"))


def question_plan(items: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """What to do about questions: ask for missing required items, resolve satisfied ones, withdraw pending ones that no longer apply."""
    both = items.join(questions.withColumnRenamed("status", "question"), key, "full_outer")
    pending = F.col("question") == "open"
    todo = (
        F.when(F.col("state").isin("found", "review_required"), F.when(F.col("question").isNotNull() & (F.col("question") != "resolved"), "resolve"))
        .when(F.col("state") == "missing", F.when(F.col("question").isNull(), "ask"))
        .when(pending, "withdraw")
    )
    return both.withColumn("todo", todo).filter("todo is not null").select(*key, "todo")


def changes(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """Long-form difference: what is new, and what changed with both values.  What disappeared is not reported."""
    old = before.select(key, F.lit(True).alias("__known"), *(F.col(c).alias(f"__{c}") for c in columns))
    both = after.select(key, *columns).join(old, key, "left")
    one = lambda c: F.when(F.col("__known").isNull() | ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.struct(F.lit(c).alias("field"), F.col(f"__{c}").cast("string").alias("before"), F.col(c).cast("string").alias("after"), F.when(F.col("__known").isNull(), "new").otherwise("changed").alias("kind")))
    return both.select(key, F.explode(F.array_compact(F.array(*map(one, columns)))).alias("d")).select(key, "d.*")


def readiness(claims: DataFrame, deductions: DataFrame, key: str, base: int = 100, floor: int = 0) -> DataFrame:
    """Score and status: deductions (key, amount, missing, attention) from the base, not under the floor.

    Claims with nothing read (read = false) score the floor and are incomplete.
    """
    sums = deductions.groupBy(key).agg(F.sum("amount").alias("deducted"), F.sum(F.col("missing").cast("int")).alias("missing"), F.sum(F.col("attention").cast("int")).alias("attention"))
    both = claims.select(key, "read").join(sums, key, "left").na.fill(0, ["deducted", "missing", "attention"])
    score = F.when(F.col("read"), F.greatest(F.lit(floor), F.lit(base) - F.col("deducted"))).otherwise(floor)
    status = F.when(~F.col("read") | (F.col("missing") > 0), "incomplete").when(F.col("attention") > 0, "needs_attention").otherwise("ready_for_human_review")
    return both.select(key, score.cast("bigint").alias("score"), "deducted", status.alias("status"))


def unchanged(now: DataFrame, stored: DataFrame, key: str, *inputs: str) -> DataFrame:
    """Rows whose input hash differs from the stored one (or has none): the only ones to evaluate again."""
    hashed = now.withColumn("input_hash", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in inputs)), 256))
    return hashed.join(stored.select(key, "input_hash"), [key, "input_hash"], "left_anti")
