"""Queries over long-form records: field maps, overrides, attempts, queues, merges and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.operators import claims as views
from dossier.plans.checks import DATE_SEQUENCE, MISSING_REQUIRED, claim_findings
from dossier.sources.tables import table

#: Extracted key -> canonical key and kind; one key may feed two fields.
FIELD_MAP = (("status", "claim.status", "text"), ("priority", "claim.priority", "text"), ("priority", "claim.rank", "integer"), ("segment", "owner.segment", "text"), ("absent", "claim.remark", "text"))
OCR_FLOOR = 0.80


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    wide = views.claims(spark, sf_dir).join(people, F.col("owner") == F.col("c_custkey"))
    return wide.select(
        "claim_id", F.explode(F.array(*(F.struct(F.lit(k).alias("field_key"), F.col(c).alias("value")) for k, c in (("status", "status"), ("priority", "priority"), ("segment", "c_mktsegment"))))).alias("f"),
    ).select("claim_id", "f.*", (F.lit(1.0) - (F.col("claim_id") % 5) / 10).alias("confidence"))


def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical field of every claim with what was extracted for it, whether it may vote, and why not."""
    fields = spark.createDataFrame(FIELD_MAP, "field_key string, canonical string, kind string")
    asked = views.claims(spark, sf_dir).select("claim_id", F.explode(F.array(*(F.struct(F.lit(k).alias("field_key"), F.lit(c).alias("canonical")) for k, c, _ in FIELD_MAP))).alias("f")).select("claim_id", "f.*")
    found = _long(spark, sf_dir).join(F.broadcast(fields.select("field_key").distinct()), "field_key", "left_semi")
    both = asked.join(found, ["claim_id", "field_key"], "left")
    eligible = F.col("value").isNotNull() & (F.col("confidence") >= OCR_FLOOR)
    reason = F.when(F.col("value").isNull(), "not stated").when(~eligible, F.concat(F.lit("read at "), F.format_string("%.2f", "confidence")))
    return both.groupBy("canonical", F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


_LONG = """l AS (
  SELECT o_orderkey AS claim_id, unnest(['status', 'priority', 'segment']) AS field_key, unnest([o_orderstatus, o_orderpriority, c_mktsegment]) AS value, CAST(1 - (o_orderkey % 5) / 10 AS DOUBLE) AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
FIELD_CANDIDATES = f"""
WITH {_LONG}, m(field_key, canonical) AS (VALUES {', '.join(f"('{k}', '{c}')" for k, c, _ in FIELD_MAP)}),
b AS (SELECT m.canonical, value, confidence FROM orders CROSS JOIN m LEFT JOIN l ON l.claim_id = o_orderkey AND l.field_key = m.field_key)
SELECT canonical, CASE WHEN value IS NULL THEN 'not stated' WHEN confidence < 0.8 THEN 'read at ' || printf('%.2f', confidence) ELSE 'eligible' END AS reason, count(*) AS n, count(DISTINCT value) AS n_values FROM b GROUP BY ALL
"""

CATALOGUE_ROWS = (("consent", True, "critical"), ("summary", True, "review"), ("bill", False, "warning"))
OVERRIDES = (("day", "consent", False, None), ("day", "bill", True, "review"), ("major", "summary", None, "critical"))


def checklist_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of each procedure: the catalogue's with the procedure's overrides over it."""
    base = spark.createDataFrame(CATALOGUE_ROWS, "requirement string, required boolean, severity string")
    over = spark.createDataFrame(OVERRIDES, "procedure string, requirement string, o_required boolean, o_severity string")
    procedures = base.withColumn("procedure", F.explode(F.array(F.lit("day"), F.lit("major"), F.lit("none"))))
    return procedures.join(over, ["procedure", "requirement"], "left").select("procedure", "requirement", F.coalesce("o_required", "required").alias("required"), F.coalesce("o_severity", "severity").alias("severity"))


CHECKLIST_OVERRIDES = """
SELECT * FROM (VALUES ('day', 'consent', false, 'critical'), ('day', 'summary', true, 'review'), ('day', 'bill', true, 'review'), ('major', 'consent', true, 'critical'), ('major', 'summary', true, 'critical'),
  ('major', 'bill', false, 'warning'), ('none', 'consent', true, 'critical'), ('none', 'summary', true, 'review'), ('none', 'bill', false, 'warning')) t(procedure, requirement, required, severity)
"""


def code_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts (clicks) against a user's newest code (signup before them): accepted within ten minutes and five attempts."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").filter("event_type in ('signup', 'click')")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    signup = F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))
    rows = rows.withColumn("code", F.last(signup, ignorenulls=True).over(order)).filter("event_type = 'click' and code is not null")
    rows = rows.withColumn("attempt", F.row_number().over(Window.partitionBy("user_id", "code.event_id").orderBy("ts", "event_id")))
    late = F.col("ts") > F.col("code.ts") + F.expr("INTERVAL 10 MINUTES")
    return rows.select("event_id", "user_id", F.col("code.event_id").alias("code"), F.col("attempt").cast("bigint").alias("attempt"), F.when(late, "expired").when(F.col("attempt") > 5, "too many").otherwise("accepted").alias("outcome"))


CODE_ATTEMPTS = """
WITH r AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS code, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER w AS since
  FROM events WHERE event_type IN ('signup', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY ts, event_id) AS attempt FROM r WHERE event_type = 'click' AND code IS NOT NULL)
SELECT event_id, user_id, code, attempt, CASE WHEN ts > since + INTERVAL 10 MINUTE THEN 'expired' WHEN attempt > 5 THEN 'too many' ELSE 'accepted' END AS outcome FROM a
"""


def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left queued or processing (views and clicks that no purchase followed) back in the queue, in order per user."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    done = rows.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("done"))
    left = rows.filter("event_type in ('view', 'click')").join(done, "user_id", "left").filter(F.col("done").isNull() | (F.struct("ts", "event_id") > F.col("done")))
    return left.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("place"))


REQUEUE = """
WITH d AS (SELECT user_id, max((ts, event_id)) AS done FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS place FROM events e LEFT JOIN d ON d.user_id = e.user_id
WHERE event_type IN ('view', 'click') AND (done IS NULL OR (ts, event_id) > done)
"""


def segment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments stored for a file (turns below 4) against those found now (turns from 1): reused, added or deleted by index."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn")
    old = rows.filter("turn < 4").select("conv_id", "turn", F.lit(True).alias("old"))
    new = rows.filter("turn >= 1").select("conv_id", "turn", F.lit(True).alias("new"))
    action = F.when(F.col("old") & F.col("new"), "reuse").when(F.col("new"), "add").otherwise("delete")
    return old.join(new, ["conv_id", "turn"], "full_outer").select("conv_id", "turn", action.alias("action"))


SEGMENT_UPSERT = "SELECT conv_id, turn, CASE WHEN turn < 4 AND turn >= 1 THEN 'reuse' WHEN turn >= 1 THEN 'add' ELSE 'delete' END AS action FROM conversations"


def adjacency_merge(spark: SparkSession, sf_dir: str, most: float = 6.0) -> DataFrame:
    """Spans on one line (a part's lines, from the day to the day plus quantity) at most six apart become one; its coverage is the least."""
    rows = views.documents(spark, sf_dir).select(F.col("party").alias("row"), F.datediff("dated", F.lit("1990-01-01").cast("date")).alias("start"), F.col("quantity").alias("size"), (1 - F.col("discount")).alias("coverage"))
    rows = rows.withColumn("end", F.col("start") + F.col("size"))
    order = Window.partitionBy("row").orderBy("start", "end", "coverage")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("begins", F.when(F.col("start") > reach + most, 1).otherwise(0))
    rows = rows.withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("row", "span").agg(F.min("start").cast("bigint").alias("left"), F.max("end").cast("bigint").alias("right"), F.round(F.min("coverage"), 4).alias("coverage")).drop("span")


ADJACENCY_MERGE = """
WITH r AS (SELECT l_suppkey AS row, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS s, l_quantity AS q, 1 - l_discount AS c FROM lineitem),
b AS (SELECT *, CASE WHEN s > max(s + q) OVER (PARTITION BY row ORDER BY s, s + q, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 6 THEN 1 ELSE 0 END AS begins FROM r),
g AS (SELECT *, sum(begins) OVER (PARTITION BY row ORDER BY s, s + q, c ROWS UNBOUNDED PRECEDING) AS span FROM b)
SELECT row, CAST(min(s) AS BIGINT) AS left, CAST(max(s + q) AS BIGINT) AS right, round(min(c), 4) AS coverage FROM g GROUP BY row, span
"""


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type of document: the true median of quantities, clamped to 7..16, and the upper one."""
    counts = views.documents(spark, sf_dir).groupBy("doc_type", "quantity").agg(F.count("*").alias("k"))
    medians = views.documents(spark, sf_dir).groupBy("doc_type").agg(F.median("quantity").alias("median"))
    # ranks come from the counts of distinct values, so no window holds a type's rows
    reached = F.sum("k").over(Window.partitionBy("doc_type").orderBy("quantity").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("reached", reached).withColumn("n", F.sum("k").over(Window.partitionBy("doc_type")))
    upper = rows.filter(F.col("reached") > F.floor(F.col("n") / 2)).groupBy("doc_type").agg(F.min("quantity").alias("upper"))
    return medians.join(upper, "doc_type").select("doc_type", F.least(F.greatest("median", F.lit(7.0)), F.lit(16.0)).alias("clamped"), "upper")


UPPER_MEDIANS = """
WITH d AS (SELECT l_returnflag || l_linestatus AS doc_type, l_quantity AS q FROM lineitem)
SELECT doc_type, least(greatest(median(q), 7.0), 16.0) AS clamped, list_sort(list(q))[count(*) // 2 + 1] AS upper FROM d GROUP BY 1
"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a run by rule and severity, kept once per claim and subject in the order of the checks."""
    of = lambda code: F.size(F.filter("findings", lambda f: f.code == code))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), of(r).alias("n")) for r, s in (("R001", "critical"), ("R008", "review"))))
    by_claim = claim_findings(spark, sf_dir).select(F.explode(rules).alias("r")).select("r.*").filter("n > 0")
    return by_claim.groupBy("rule", "severity").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_claims"))


RUN_SUMMARY = f"""
SELECT rule, severity, count(*) AS n_findings, count(DISTINCT claim_id) AS n_claims FROM (
  SELECT DISTINCT claim_id, subject, 'R001' AS rule, 'critical' AS severity FROM ({MISSING_REQUIRED}) UNION ALL SELECT DISTINCT claim_id, subject, 'R008', 'review' FROM ({DATE_SEQUENCE})
) GROUP BY ALL
"""


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the workspace's tables."""
    names = ("orders", "lineitem", "customer", "events", "documents", "pages")
    found = None
    for name in names:
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        found = one if found is None else found.unionAll(one)
    return found


ROW_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n FROM {n}" for n in ("orders", "lineitem", "customer", "events", "documents", "pages"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human decisions of three kinds in one list, numbered in the order of time, kind and subject per user."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    kinds = {"signup": "answer", "click": "finding", "purchase": "approval"}
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()))
    chosen = rows.withColumn("kind", kind).filter("kind is not null")
    return chosen.select("user_id", "event_id", "kind", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "kind", "event_id")).cast("bigint").alias("place"))


DECISIONS = """
WITH k AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'answer' WHEN 'click' THEN 'finding' WHEN 'purchase' THEN 'approval' END AS kind FROM events)
SELECT user_id, event_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, kind, event_id) AS place FROM k WHERE kind IS NOT NULL
"""

CATALOGUE = {
    "field_candidates": (field_candidates, FIELD_CANDIDATES),
    "checklist_overrides": (checklist_overrides, CHECKLIST_OVERRIDES),
    "code_attempts": (code_attempts, CODE_ATTEMPTS),
    "requeue": (requeue, REQUEUE),
    "segment_upsert": (segment_upsert, SEGMENT_UPSERT),
    "adjacency_merge": (adjacency_merge, ADJACENCY_MERGE),
    "upper_medians": (upper_medians, UPPER_MEDIANS),
    "run_summary": (run_summary, RUN_SUMMARY),
    "row_counts": (row_counts, ROW_COUNTS),
    "decisions": (decisions, DECISIONS),
}
