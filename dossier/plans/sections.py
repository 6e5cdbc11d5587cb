"""Sections of a claim's report: ordered findings, the checklist's summary, charges that count once, workflow states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.plans.checks import DATE_SEQUENCE, MISSING_REQUIRED, REQUIREMENT_STATUS, claim_findings, requirement_status
from dossier.plans.workflow import READINESS_SCORE, readiness_score

STATES = ("found", "review_required", "missing", "not_applicable")
STEPS = ("read documents", "complete documents", "review findings", "approve")
#: Points a finding costs, by severity rank.
CHARGES = (10, 3)


_FINDINGS = f"""
m AS ({MISSING_REQUIRED}), ds AS ({DATE_SEQUENCE}),
f AS (SELECT claim_id, 'R001' AS code, 0 AS rank, subject FROM m UNION SELECT claim_id, 'R008', 1, subject FROM ds)"""


def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each claim by severity, then code, then subject."""
    listed = claim_findings(spark, sf_dir).select("claim_id", F.posexplode("findings").alias("place", "f"))
    return listed.select("claim_id", (F.col("place") + 1).cast("bigint").alias("place"), "f.code", "f.subject")


FINDING_ORDER = f"WITH {_FINDINGS} SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY rank, code, subject) AS place, code, subject FROM f"


def checklist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per claim the number of items in each state, and whether nothing is missing or to be reviewed."""
    items = requirement_status(spark, sf_dir)
    counted = items.groupBy("claim_id").agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in STATES))
    return counted.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_review_required") == 0))


_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in STATES)
CHECKLIST_SUMMARY = f"WITH i AS ({REQUIREMENT_STATUS}), c AS (SELECT claim_id, {_COUNTS} FROM i GROUP BY 1) SELECT *, n_missing = 0 AND n_review_required = 0 AS complete FROM c"


def charge_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings cost a claim: those whose requirement the checklist charges as missing cost nothing more."""
    left = F.filter("findings", lambda f: ~f.charged)
    points = F.aggregate(left, F.lit(0).cast("bigint"), lambda sum_, f: sum_ + F.element_at(F.array(*map(F.lit, CHARGES)), f["rank"] + 1))
    return claim_findings(spark, sf_dir).select("claim_id", F.size(left).cast("bigint").alias("n_charged"), points.alias("charge")).filter("n_charged > 0")


CHARGE_ONCE = f"""
WITH {_FINDINGS}, i AS ({REQUIREMENT_STATUS})
SELECT claim_id, count(*) AS n_charged, CAST(sum(CASE rank WHEN 0 THEN {CHARGES[0]} ELSE {CHARGES[1]} END) AS BIGINT) AS charge
FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.claim_id = f.claim_id AND i.state = 'missing' AND 'requirement:' || i.requirement = f.subject) GROUP BY 1
"""


def workflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every claim: those before the current one are complete, those after it pending."""
    at = F.when(F.col("score") == 0, 0).when(F.col("status") == "incomplete", 1).when(F.col("status") == "needs_attention", 2).otherwise(3)
    steps = readiness_score(spark, sf_dir).select("claim_id", at.alias("at"), F.posexplode(F.array(*map(F.lit, STEPS))).alias("place", "step"))
    state = F.when(F.col("place") < F.col("at"), "complete").when(F.col("place") == F.col("at"), "current").otherwise("pending")
    return steps.select("claim_id", F.col("place").cast("bigint").alias("place"), "step", state.alias("state"))


_STEPS = ", ".join(f"({k}, '{s}')" for k, s in enumerate(STEPS))
WORKFLOW_STATES = f"""
WITH r AS ({READINESS_SCORE}), s(place, step) AS (VALUES {_STEPS}),
p AS (SELECT claim_id, CASE WHEN score = 0 THEN 0 WHEN status = 'incomplete' THEN 1 WHEN status = 'needs_attention' THEN 2 ELSE 3 END AS reached FROM r)
SELECT claim_id, CAST(place AS BIGINT) AS place, step, CASE WHEN place < reached THEN 'complete' WHEN place = reached THEN 'current' ELSE 'pending' END AS state FROM p CROSS JOIN s
"""

CATALOGUE = {
    "finding_order": (finding_order, FINDING_ORDER),
    "checklist_summary": (checklist_summary, CHECKLIST_SUMMARY),
    "charge_once": (charge_once, CHARGE_ONCE),
    "workflow_states": (workflow_states, WORKFLOW_STATES),
}
