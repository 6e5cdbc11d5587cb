"""Queries over claim-shaped views: joins, filters, counts, numbering, dashboards, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.operators import claims as views
from dossier.operators.ranking import last_rows, marginals, zero_filled
from dossier.sources.tables import table

STATUSES, PRIORITIES = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ACTIVE = ("O", "P")


def claims_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with the number of its documents, 0 if none."""
    counted = views.documents(spark, sf_dir).groupBy("claim_id").agg(F.count("*").alias("n_documents"))
    return views.claims(spark, sf_dir).join(counted, "claim_id", "left").select("claim_id", "owner", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


CLAIMS_WITH_COUNTS = """
SELECT o_orderkey AS claim_id, o_custkey AS owner, coalesce(n, 0) AS n_documents
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
"""


def audit_visible(spark: SparkSession, sf_dir: str, owner_below: int = 50) -> DataFrame:
    """Events of users that own a claim among the first owners, and events of no one."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    owners = table(spark, sf_dir, "orders", "o_custkey").filter(F.col("o_custkey") < owner_below).select(F.col("o_custkey").alias("user_id"))
    own = events.join(owners, "user_id", "left_semi").select("event_id", "user_id", "event_type")
    return own.unionByName(events.filter("user_id is null").select("event_id", "user_id", "event_type"))


AUDIT_VISIBLE = "SELECT event_id, user_id, event_type FROM events WHERE user_id IS NULL OR user_id IN (SELECT o_custkey FROM orders WHERE o_custkey < 50)"


def active_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents processed (dated after 1995) and not excluded (returned), per claim."""
    docs = views.documents(spark, sf_dir).filter("dated > date'1995-12-31' and doc_type not like 'R%'")
    return docs.groupBy("claim_id").agg(F.count("*").alias("n_active"), F.sort_array(F.collect_set("doc_type")).alias("types")).withColumn("types", F.array_join("types", ","))


ACTIVE_DOCS = """
SELECT l_orderkey AS claim_id, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS types
FROM lineitem WHERE CAST(l_shipdate AS DATE) > DATE '1995-12-31' AND l_returnflag <> 'R' GROUP BY 1
"""


def findings_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (claims) that are active and of the two upper severities; rows come in no order."""
    rows = views.claims(spark, sf_dir).filter(F.col("status").isin(*ACTIVE) & F.col("priority").isin(*PRIORITIES[:2]))
    return rows.select("claim_id", "status", "priority")


def owner_scope(spark: SparkSession, sf_dir: str, owner: int = 7) -> DataFrame:
    """The claims of one owner and nobody else's."""
    return views.claims(spark, sf_dir).filter(F.col("owner") == owner).select("claim_id", "owner", "status")


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity, by status and in all from one pass, over the full domain."""
    counted = marginals(views.claims(spark, sf_dir), "priority", "status", F.col("status").isin(*ACTIVE))
    key = F.when(F.col("priority").isNotNull(), F.concat(F.lit("severity:"), "priority")).when(F.col("status").isNotNull(), F.concat(F.lit("status:"), "status")).otherwise("total")
    domain = [f"severity:{p}" for p in PRIORITIES] + [f"status:{s}" for s in STATUSES] + ["status:X", "total"]
    every = spark.createDataFrame([(d,) for d in domain], "key string")
    return zero_filled(every, counted.select(key.alias("key"), "n", "n_active"), "key", "n", "n_active")


FINDING_SUMMARY = f"""
WITH d(key) AS (VALUES {', '.join(f"('severity:{p}')" for p in PRIORITIES)}, ('status:F'), ('status:O'), ('status:P'), ('status:X'), ('total')),
a AS (
  SELECT 'severity:' || o_orderpriority AS key, count(*) AS n, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS n_active FROM orders GROUP BY 1
  UNION ALL SELECT 'status:' || o_orderstatus, count(*), count(*) FILTER (o_orderstatus IN ('O', 'P')) FROM orders GROUP BY 1
  UNION ALL SELECT 'total', count(*), count(*) FILTER (o_orderstatus IN ('O', 'P')) FROM orders
) SELECT d.key, coalesce(n, 0) AS n, coalesce(n_active, 0) AS n_active FROM d LEFT JOIN a USING (key)
"""


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner: claims by status, in columns."""
    return views.claims(spark, sf_dir).groupBy("owner").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES))


STATUS_PIVOT = "SELECT o_custkey AS owner, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS n_{s.lower()}" for s in STATUSES) + " FROM orders GROUP BY 1"


def claim_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers per owner in the order of date and id, from 123."""
    n = F.row_number().over(Window.partitionBy("owner").orderBy("stated_on", "claim_id")) + 122
    return views.claims(spark, sf_dir).select("claim_id", "owner", F.format_string("CLM-%05d", n).alias("claim_number"))


CLAIM_NUMBERS = "SELECT o_orderkey AS claim_id, o_custkey AS owner, 'CLM-' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) + 122 AS VARCHAR), 5, '0') AS claim_number FROM orders"


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 hex digits of SHA-256 over rule and subject."""
    subject = F.concat(F.lit("R012|bill_number:"), F.col("claim_id").cast("string"))
    return views.claims(spark, sf_dir).select("claim_id", F.substring(F.sha2(subject, 256), 1, 40).alias("fingerprint"))


FINGERPRINT = "SELECT o_orderkey AS claim_id, substr(sha256('R012|bill_number:' || CAST(o_orderkey AS VARCHAR)), 1, 40) AS fingerprint FROM orders"


def top_claims(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """The newest claims."""
    return views.claims(spark, sf_dir).select("claim_id", "stated_on", "status", F.col("total").cast("double").alias("total")).orderBy(F.desc("stated_on"), F.desc("claim_id")).limit(n)


TOP_CLAIMS = "SELECT o_orderkey AS claim_id, CAST(o_orderdate AS DATE) AS stated_on, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 50"


def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all claims in one aggregate: counts, sums, the mean score half to even."""
    rows = views.claims(spark, sf_dir)
    score = F.pmod(F.col("claim_id"), F.lit(101))
    return rows.agg(
        F.count("*").alias("n_claims"), F.count_if(F.col("status").isin(*ACTIVE)).alias("n_active"),
        F.bround(F.avg(score), 0).cast("bigint").alias("mean_score"), F.sum("total").cast("double").alias("total"), F.countDistinct("owner").alias("n_owners"),
    )


DASHBOARD_TOTALS = """
SELECT count(*) AS n_claims, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS n_active, CAST(round_even(avg(o_orderkey % 101), 0) AS BIGINT) AS mean_score,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(DISTINCT o_custkey) AS n_owners FROM orders
"""


def rate_limit_1h(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """Signups (codes asked for) of a user in the hour up to each one, and whether it is over the limit."""
    asked = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    hour = Window.partitionBy("user_id").orderBy(F.col("ts").cast("double")).rangeBetween(-3600, 0)
    return asked.withColumn("in_hour", F.count("*").over(hour)).select("event_id", "user_id", "in_hour", (F.col("in_hour") > most).alias("refused"))


RATE_LIMIT = """
SELECT event_id, user_id, count(*) OVER w AS in_hour, count(*) OVER w > 5 AS refused FROM events WHERE event_type = 'signup'
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
"""


def latest_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest unused code (a signup with a value over 10) of each user."""
    asked = table(spark, sf_dir, "events").filter("event_type = 'signup' and value > 10")
    return asked.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last")).select("user_id", F.col("last.event_id").alias("event_id"))


LATEST_CHALLENGE = "SELECT user_id, event_id FROM events WHERE event_type = 'signup' AND value > 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def audit_tail(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The last events of each user, numbered from the newest."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return last_rows(rows, "user_id", n, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", F.col("place").cast("bigint").alias("place"))


AUDIT_TAIL = "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 20"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (conversations) with their documents (turns): count, span and types in order."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    grouped = rows.groupBy("conv_id").agg(F.count("*").alias("n_pages"), F.min("turn").alias("first_page"), F.max("turn").alias("last_page"), F.sort_array(F.collect_set("role")).alias("types"))
    span = F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", "first_page", "last_page"))
    return grouped.select("conv_id", "n_pages", span.alias("page_span"), F.array_join("types", ", ").alias("types"))


SOURCE_FILES = """
SELECT conv_id, count(*) AS n_pages, CASE WHEN min(turn) = max(turn) THEN CAST(min(turn) AS VARCHAR) ELSE min(turn) || '-' || max(turn) END AS page_span,
  array_to_string(list_sort(list_distinct(list(role))), ', ') AS types FROM conversations GROUP BY 1
"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: mean progress, first start and last end of the stages that events mark."""
    rows = table(spark, sf_dir, "events").withColumn("stage", F.array_position(F.array(*map(F.lit, ("signup", "view", "click", "purchase"))), F.col("event_type")))
    done = F.round(F.avg(F.when(F.col("stage") > 0, (F.col("stage") - 1) / F.lit(3.0))), 3)
    return rows.groupBy("user_id").agg(done.alias("progress"), F.min("event_id").alias("first_event"), F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("last_end"))


PROGRESS = """
SELECT user_id, CAST(round(avg(CASE event_type WHEN 'signup' THEN 0.0 WHEN 'view' THEN 1/3.0::DOUBLE WHEN 'click' THEN 2/3.0::DOUBLE WHEN 'purchase' THEN 1.0 END), 3) AS DOUBLE) AS progress,
  min(event_id) AS first_event, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS last_end FROM events GROUP BY 1
"""


def preferred_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that answers a claim's question: its own first (line 1), else the earliest."""
    order = Window.partitionBy("claim_id").orderBy(F.desc(F.col("line") == 1), "dated", "line", "part", "party", "quantity")
    return views.documents(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter("place = 1").select("claim_id", F.col("line").cast("bigint").alias("line"), "dated", "doc_type")


PREFERRED_DOCUMENT = """
SELECT l_orderkey AS claim_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_shipdate AS DATE) AS dated, l_returnflag || l_linestatus AS doc_type FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber = 1 DESC, CAST(l_shipdate AS DATE), l_linenumber, l_partkey, l_suppkey, l_quantity) = 1
"""


def scoped_reset(spark: SparkSession, sf_dir: str, owner: int = 7) -> DataFrame:
    """What stays of the documents when one owner's claims are deleted."""
    gone = views.claims(spark, sf_dir).filter(F.col("owner") == owner).select("claim_id")
    return views.documents(spark, sf_dir).join(gone, "claim_id", "left_anti").groupBy("doc_type").agg(F.count("*").alias("n_kept"))


SCOPED_RESET = "SELECT l_returnflag || l_linestatus AS doc_type, count(*) AS n_kept FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) GROUP BY 1"

CATALOGUE = {
    "claims_with_counts": (claims_with_counts, CLAIMS_WITH_COUNTS),
    "audit_visible": (audit_visible, AUDIT_VISIBLE),
    "active_docs": (active_docs, ACTIVE_DOCS),
    "findings_filter": (findings_filter, "SELECT o_orderkey AS claim_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "owner_scope": (owner_scope, "SELECT o_orderkey AS claim_id, o_custkey AS owner, o_orderstatus AS status FROM orders WHERE o_custkey = 7"),
    "finding_summary": (finding_summary, FINDING_SUMMARY),
    "status_pivot": (status_pivot, STATUS_PIVOT),
    "claim_numbers": (claim_numbers, CLAIM_NUMBERS),
    "fingerprint": (fingerprint, FINGERPRINT),
    "top_claims": (top_claims, TOP_CLAIMS),
    "dashboard_totals": (dashboard_totals, DASHBOARD_TOTALS),
    "rate_limit_1h": (rate_limit_1h, RATE_LIMIT),
    "latest_challenge": (latest_challenge, LATEST_CHALLENGE),
    "audit_tail": (audit_tail, AUDIT_TAIL),
    "source_files": (source_files, SOURCE_FILES),
    "progress": (progress, PROGRESS),
    "preferred_document": (preferred_document, PREFERRED_DOCUMENT),
    "scoped_reset": (scoped_reset, SCOPED_RESET),
}
