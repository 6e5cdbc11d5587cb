"""Deterministic answers: an intent picks a template, citations are checked, banned sentences go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import intent, plural, scrub

INTENTS = {
    "missing": ("missing", "absent", "outstanding"), "findings": ("finding", "wrong", "problem"), "score": ("score", "ready", "readiness"),
    "next": ("next", "what should"), "documents": ("document", "file"),
}
BANNED = ["fraud", "guilty", "fake"]
MARK = r"\[([a-z]+):([0-9]+)\]"


def answer(questions: DataFrame, state: DataFrame) -> DataFrame:
    """claim_id, intent, answer.  questions: claim_id, question; state: claim_id, score, missing, findings, documents (arrays of words)."""
    asked = questions.withColumn("intent", intent(F.col("question"), INTENTS)).join(state, "claim_id", "left")
    listed = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(": "), F.array_join(F.slice(F.array_sort(c), 1, 8), ", "))).otherwise("")
    text = (
        F.when(F.col("score").isNull(), "This claim is not known.")
        .when(F.col("intent") == "missing", F.concat(plural(F.size("missing"), "requirement"), F.lit(" missing"), listed("missing"), F.lit(".")))
        .when(F.col("intent") == "findings", F.concat(plural(F.size("findings"), "open finding"), listed("findings"), F.lit(".")))
        .when(F.col("intent") == "score", F.concat(F.lit("The documentation scores "), F.col("score").cast("string"), F.lit(".")))
        .when(F.col("intent") == "next", F.when(F.size("missing") > 0, F.concat(F.lit("Add what is missing"), listed("missing"), F.lit("."))).otherwise("Review the open findings."))
        .when(F.col("intent") == "documents", F.concat(plural(F.size("documents"), "document"), listed("documents"), F.lit(".")))
        .otherwise("Ask about what is missing, findings, documents or the score.")
    )
    return asked.select("claim_id", "intent", text.alias("answer"))


def guarded(texts: DataFrame, known: DataFrame) -> DataFrame:
    """id, text, unknown: citation marks [kind:number] that are not in ``known`` (id, kind, number) are cut out and reported."""
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(MARK), F.lit(0)))
    cited = texts.select("id", F.explode(marks).alias("mark"))
    real = known.select("id", F.concat(F.lit("["), "kind", F.lit(":"), F.col("number").cast("string"), F.lit("]")).alias("mark")).distinct()
    wrong = cited.join(real, ["id", "mark"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("mark")).alias("unknown"))
    both = texts.join(wrong, "id", "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    cut = F.aggregate("unknown", F.col("text"), lambda t, m: F.replace(t, m, F.lit("")))
    clean = scrub(F.regexp_replace(cut, r"\s+([.!?,])", "$1"), BANNED)
    return both.select("id", F.when(clean == "", "No answer can be given from the documents.").otherwise(clean).alias("text"), "unknown")
