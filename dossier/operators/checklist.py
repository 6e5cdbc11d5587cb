"""Checklists: documents and findings related to requirements, through arrays and through shared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities, most serious first; those that send a requirement to review.
SEVERITIES, REVIEWED = ("critical", "review", "warning", "info"), ("critical", "review")


def related(matches: DataFrame, findings: DataFrame, by_type: DataFrame, raised_for: DataFrame) -> DataFrame:
    """claim_id, requirement, finding_id, cites (whether it names a matching document), active, severity, rule: each finding once.

    A finding relates to a requirement by a document that it names and that matches, or by a subject ``requirement:x`` whose
    x asks for a type (``raised_for``: asked, doc_type) that the requirement accepts (``by_type``: requirement, doc_type).
    Documents are met on (claim, document), so a frequent type or a large claim is spread over its documents.
    """
    kept = ["finding_id", "rule", "severity", "active"]
    named = findings.select("claim_id", *kept, F.explode(F.array_distinct("document_ids")).alias("doc_id"))
    by_document = named.join(matches, ["claim_id", "doc_id"]).select("claim_id", "requirement", *kept, F.lit(True).alias("cites"))
    asks = raised_for.join(by_type, "doc_type").select("asked", "requirement").distinct()
    asked = F.when(F.startswith("subject", F.lit("requirement:")), F.substring("subject", len("requirement:") + 1, 2**31 - 1))
    by_subject = findings.withColumn("asked", asked).join(F.broadcast(asks), "asked").select("claim_id", "requirement", *kept, F.lit(False).alias("cites"))
    return by_document.unionByName(by_subject).groupBy("claim_id", "requirement", "finding_id").agg(F.max("cites").alias("cites"), *(F.max(c).alias(c) for c in kept[1:]))


def evaluate(claims: DataFrame, documents: DataFrame, findings: DataFrame, requirements: dict[str, tuple[str, ...]], applies: dict[str, Column], raised_for: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per claim and requirement: status, because, n_documents, n_shadowed, n_findings, first_finding.

    claims: claim_id and whatever the conditions in ``applies`` read (no condition: always).  documents: claim_id, doc_id,
    doc_type, usable, excluded.  findings: claim_id, finding_id, rule, severity, active, subject, document_ids.  In order:
    not_applicable where the condition does not hold (false or null), review_required where an active finding of a reviewed
    severity names a matching document, found where one matches, else missing, because its only documents are excluded
    (shadowed) or because there are none (absent).  first_finding: active first, most serious, rule, then id.  Null types match nothing.
    """
    spark = claims.sparkSession
    # both relations are configuration: as long as the dictionaries
    by_type = F.broadcast(spark.createDataFrame([(k, t) for k, types in requirements.items() for t in types], "requirement string, doc_type string"))
    raised = spark.createDataFrame([(k, t) for k, types in raised_for.items() for t in types], "asked string, doc_type string")
    typed = documents.join(by_type, "doc_type")
    matches = typed.filter("usable").select("claim_id", "requirement", "doc_id")
    tallied = typed.groupBy("claim_id", "requirement").agg(F.count_if("usable").alias("n_documents"), F.count_if(F.col("excluded") & ~F.col("usable")).alias("n_shadowed"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    order = F.struct((~F.col("active")).alias("closed"), F.when(place > 0, place).otherwise(9).alias("place"), "rule", "finding_id")
    charged = F.col("cites") & F.col("active") & F.col("severity").isin(*REVIEWED)
    found = related(matches.distinct(), findings, by_type, raised).groupBy("claim_id", "requirement").agg(F.count("*").alias("n_findings"), F.count_if(charged).alias("n_open"), F.min(order).alias("first"))
    holds = F.map_from_arrays(F.array(*map(F.lit, requirements)), F.array(*(F.coalesce(applies.get(k, F.lit(True)), F.lit(False)) for k in requirements)))
    asked = claims.select("claim_id", F.explode(holds).alias("requirement", "holds"))
    both = asked.join(tallied, ["claim_id", "requirement"], "left").join(found, ["claim_id", "requirement"], "left").na.fill(0, ["n_documents", "n_shadowed", "n_findings", "n_open"])
    status = F.when(~F.col("holds"), "not_applicable").when((F.col("n_documents") > 0) & (F.col("n_open") > 0), "review_required").when(F.col("n_documents") > 0, "found").otherwise("missing")
    because = F.when(~F.col("holds"), "condition").when(F.col("n_documents") > 0, F.when(F.col("n_open") > 0, "open_findings").otherwise("documents")).when(F.col("n_shadowed") > 0, "shadowed").otherwise("absent")
    only = lambda c, other: F.when(F.col("holds"), c).otherwise(other)
    return both.select(
        "claim_id", "requirement", status.alias("status"), because.alias("because"), only(F.col("n_documents"), 0).alias("n_documents"), only(F.col("n_shadowed"), 0).alias("n_shadowed"),
        only(F.col("n_findings"), 0).alias("n_findings"), only(F.col("first.finding_id"), None).alias("first_finding"),
    )
