"""Queries that vote canonical values and evaluate the claim checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.values import MONEY
from dossier.operators import claims as views
from dossier.operators.ranking import competing, vote, wording
from dossier.sources.tables import table

TOLERANCE = "0.00"
REQUIRED = {"consent": ("AF", "AO"), "summary": ("NO", "NF"), "bill": ("RF",)}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the documents of a claim state for the field "type": line 1 to 3 weigh 3, discounted lines are not eligible."""
    docs = views.documents(spark, sf_dir)
    return docs.select(
        "claim_id", F.lit("doc_type").alias("field"), F.col("doc_type").alias("value"), F.lower(F.substring("doc_type", 1, 1)).alias("normal"),
        F.when(F.col("line") <= 3, 3).otherwise(1).alias("weight"), (F.col("discount") < 0.08).alias("eligible"), (1 - F.col("discount")).alias("confidence"),
    )


_CANDIDATES = """c AS (
  SELECT l_orderkey AS claim_id, l_returnflag || l_linestatus AS value, lower(l_returnflag) AS normal, CASE WHEN l_linenumber <= 3 THEN 3 ELSE 1 END AS weight,
    l_discount < 0.08 AS eligible, 1 - l_discount AS confidence FROM lineitem
), t AS (
  SELECT claim_id, normal, CAST(sum(CASE WHEN eligible THEN weight ELSE 0 END) AS BIGINT) AS weight, count(*) FILTER (eligible) AS n_eligible, count(*) AS n_sources,
    max(CASE WHEN eligible THEN confidence END) AS confidence FROM c GROUP BY ALL
), v AS (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n_eligible > 0 DESC, weight DESC, n_eligible DESC, confidence DESC NULLS LAST, normal) AS rank FROM t
)"""


def canonical_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen value of each claim; claims without an eligible source have the field, but absent."""
    voted = vote(candidates(spark, sf_dir), "claim_id", "field").filter("rank = 1")
    claims = views.claims(spark, sf_dir).select("claim_id")
    found = claims.join(voted, "claim_id", "left")
    chosen = F.coalesce("chosen", F.lit(False))
    return found.select("claim_id", chosen.alias("present"), F.when(chosen, F.col("normal")).alias("normal"), F.when(chosen, F.col("weight")).alias("weight"), F.when(chosen, F.round("confidence", 6)).alias("confidence"))


CANONICAL_VOTE = f"""
WITH {_CANDIDATES}
SELECT o_orderkey AS claim_id, coalesce(n_eligible > 0, false) AS present, CASE WHEN n_eligible > 0 THEN normal END AS normal,
  CASE WHEN n_eligible > 0 THEN weight END AS weight, CASE WHEN n_eligible > 0 THEN round(confidence, 6) END AS confidence
FROM orders LEFT JOIN (SELECT * FROM v WHERE rank = 1) ON claim_id = o_orderkey
"""


def competing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each claim's documents state against the chosen value."""
    found = competing(vote(candidates(spark, sf_dir), "claim_id", "field"), "claim_id", "field")
    return found.select("claim_id", "normal", "weight", "n_sources", F.col("place").cast("bigint").alias("place"))


COMPETING_VALUES = f"""
WITH {_CANDIDATES}
SELECT claim_id, normal, weight, n_sources, row_number() OVER (PARTITION BY claim_id ORDER BY weight DESC, n_sources DESC, normal) AS place
FROM v WHERE NOT (rank = 1 AND n_eligible > 0)
"""


def value_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other wordings inside the winning group of a claim."""
    rows = candidates(spark, sf_dir)
    won = vote(rows, "claim_id", "field").filter("chosen").select("claim_id", "normal")
    inside = rows.join(won, ["claim_id", "normal"])
    stated = wording(inside, "claim_id").select("claim_id", F.col("value").alias("stated"))
    return inside.join(stated, "claim_id").filter("value <> stated").groupBy("claim_id", "stated", F.col("value").alias("variant")).agg(F.count("*").alias("n"))


_WORDING = "w AS (SELECT claim_id, value FROM (SELECT c.claim_id, c.value, count(*) AS n, max(c.weight) AS h FROM c JOIN v ON c.claim_id = v.claim_id AND c.normal = v.normal AND rank = 1 AND n_eligible > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, h DESC, value) = 1)"
VALUE_VARIANTS = f"""
WITH {_CANDIDATES}, {_WORDING}
SELECT c.claim_id, w.value AS stated, c.value AS variant, count(*) AS n FROM c JOIN v ON c.claim_id = v.claim_id AND c.normal = v.normal AND rank = 1 AND n_eligible > 0
JOIN w ON w.claim_id = c.claim_id WHERE c.value <> w.value GROUP BY ALL
"""


def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wording printed most in a claim, ties to the heavier document, then to the alphabet."""
    return wording(candidates(spark, sf_dir), "claim_id").select("claim_id", "value", "n")


MODE_TIEBREAK = f"WITH {_CANDIDATES} SELECT claim_id, value, n FROM (SELECT claim_id, value, count(*) AS n, max(weight) AS h FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, h DESC, value) = 1"


def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of each claim none of whose accepted types it has."""
    types = spark.createDataFrame([(k, t) for k, ts in REQUIRED.items() for t in ts], "requirement string, doc_type string")
    have = views.documents(spark, sf_dir).select("claim_id", "doc_type").distinct()
    met = have.join(F.broadcast(types), "doc_type").select("claim_id", "requirement").distinct()
    asked = views.claims(spark, sf_dir).select("claim_id", F.explode(F.array(*map(F.lit, REQUIRED))).alias("requirement"))
    return asked.join(met, ["claim_id", "requirement"], "left_anti").withColumn("subject", F.concat(F.lit("requirement:"), "requirement"))


_TYPES = ", ".join(f"('{k}', '{t}')" for k, ts in REQUIRED.items() for t in ts)
MISSING_REQUIRED = f"""
WITH r(requirement, doc_type) AS (VALUES {_TYPES}), met AS (SELECT DISTINCT l_orderkey AS claim_id, requirement FROM lineitem JOIN r ON doc_type = l_returnflag || l_linestatus)
SELECT o_orderkey AS claim_id, k.requirement, 'requirement:' || k.requirement AS subject FROM orders, (SELECT DISTINCT requirement FROM r) k
WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.claim_id = o_orderkey AND met.requirement = k.requirement)
"""


def requirement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checklist status per claim and requirement: not applicable for closed claims, then review, found or missing."""
    types = spark.createDataFrame([(k, t) for k, ts in REQUIRED.items() for t in ts], "requirement string, doc_type string")
    docs = views.documents(spark, sf_dir).join(F.broadcast(types), "doc_type")
    met = docs.groupBy("claim_id", "requirement").agg(F.count("*").alias("n_documents"), F.count_if(F.col("discount") > 0.09).alias("n_review"))
    asked = views.claims(spark, sf_dir).select("claim_id", "status", F.explode(F.array(*map(F.lit, REQUIRED))).alias("requirement"))
    state = F.when((F.col("status") == "F") & (F.col("requirement") == "consent"), "not_applicable").when(F.col("n_review") > 0, "review_required").when(F.col("n_documents") > 0, "found").otherwise("missing")
    return asked.join(met, ["claim_id", "requirement"], "left").select("claim_id", "requirement", state.alias("state"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


REQUIREMENT_STATUS = f"""
WITH r(requirement, doc_type) AS (VALUES {_TYPES}),
m AS (SELECT l_orderkey AS claim_id, requirement, count(*) AS n, count(*) FILTER (l_discount > 0.09) AS nr FROM lineitem JOIN r ON doc_type = l_returnflag || l_linestatus GROUP BY ALL)
SELECT o_orderkey AS claim_id, k.requirement, CASE WHEN o_orderstatus = 'F' AND k.requirement = 'consent' THEN 'not_applicable' WHEN nr > 0 THEN 'review_required' WHEN n > 0 THEN 'found' ELSE 'missing' END AS state,
  coalesce(n, 0) AS n_documents FROM orders CROSS JOIN (SELECT DISTINCT requirement FROM r) k LEFT JOIN m ON m.claim_id = o_orderkey AND m.requirement = k.requirement
"""


def line_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill lines whose amount is not quantity times rate, half to even, within the tolerance; with the difference."""
    lines = views.bill_lines(spark, sf_dir)
    expected = F.bround(F.col("quantity") * F.col("rate"), 2).cast(MONEY)
    found = lines.withColumn("expected", expected).withColumn("difference", F.abs(F.col("expected") - F.col("amount")))
    return found.filter(F.col("difference") > F.lit(TOLERANCE).cast(MONEY)).select("bill_id", "line", *(F.col(c).cast("double").alias(c) for c in ("expected", "amount", "difference")))


_LINES = "SELECT l_orderkey AS bill_id, l_linenumber AS line, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(p_retailprice AS DECIMAL(18,2)) AS r, CAST(l_extendedprice AS DECIMAL(18,2)) AS a FROM lineitem JOIN part ON l_partkey = p_partkey"
LINE_ARITHMETIC = f"""
WITH b AS ({_LINES}), e AS (SELECT bill_id, line, CAST(round_even(q * r, 2) AS DECIMAL(18,2)) AS expected, a FROM b)
SELECT bill_id, line, CAST(expected AS DOUBLE) AS expected, CAST(a AS DOUBLE) AS amount, CAST(abs(expected - a) AS DOUBLE) AS difference FROM e WHERE abs(expected - a) > 0
"""


def subtotal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bill: sum of lines against the stated total, exactly (a subtotal has no tolerance)."""
    sums = views.bill_lines(spark, sf_dir).groupBy("bill_id").agg(F.sum("amount").cast(MONEY).alias("sum_lines"), F.count("*").alias("n_lines"))
    bills = views.claims(spark, sf_dir).select(F.col("claim_id").alias("bill_id"), "total")
    off = F.abs(F.col("sum_lines") - F.col("total"))
    return bills.join(sums, "bill_id", "left").select(
        "bill_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.col("sum_lines").cast("double").alias("sum_lines"),
        F.when(F.col("sum_lines").isNull(), "not_applicable").when(off == 0, "pass").otherwise("fail").alias("status"),
    )


SUBTOTAL_CHECK = f"""
WITH b AS ({_LINES}), s AS (SELECT bill_id, CAST(sum(a) AS DECIMAL(18,2)) AS sl, count(*) AS n FROM b GROUP BY 1)
SELECT o_orderkey AS bill_id, coalesce(n, 0) AS n_lines, CAST(sl AS DOUBLE) AS sum_lines,
  CASE WHEN sl IS NULL THEN 'not_applicable' WHEN sl = CAST(o_totalprice AS DECIMAL(18,2)) THEN 'pass' ELSE 'fail' END AS status
FROM orders LEFT JOIN s ON bill_id = o_orderkey
"""


def total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotal + tax - |discount| against the total per bill; skipped where no tax is stated and the total is above the subtotal."""
    lines = views.bill_lines(spark, sf_dir)
    part = lambda c: F.sum(F.bround(F.col("amount") * F.col(c), 2).cast(MONEY)).cast(MONEY)
    sums = lines.groupBy("bill_id").agg(F.sum("amount").cast(MONEY).alias("subtotal"), part("tax").alias("tax"), part("discount").alias("discount"))
    both = sums.join(views.claims(spark, sf_dir).select(F.col("claim_id").alias("bill_id"), "total"), "bill_id")
    expected = F.col("subtotal") + F.col("tax") - F.abs("discount")
    status = F.when((F.col("tax") == 0) & (F.col("total") > F.col("subtotal")), "skipped").when(F.abs(expected - F.col("total")) <= 0, "pass").otherwise("fail")
    return both.select("bill_id", expected.cast("double").alias("expected"), status.alias("status"))


TOTAL_CHECK = """
WITH b AS (
  SELECT l_orderkey AS bill_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(l_tax AS DECIMAL(18,2)) AS t, CAST(l_discount AS DECIMAL(18,2)) AS d FROM lineitem JOIN part ON l_partkey = p_partkey
), s AS (SELECT bill_id, sum(a) AS sub, sum(CAST(round_even(a * t, 2) AS DECIMAL(18,2))) AS tax, sum(CAST(round_even(a * d, 2) AS DECIMAL(18,2))) AS disc FROM b GROUP BY 1)
SELECT bill_id, CAST(sub + tax - abs(disc) AS DOUBLE) AS expected,
  CASE WHEN tax = 0 AND CAST(o_totalprice AS DECIMAL(18,2)) > sub THEN 'skipped' WHEN sub + tax - abs(disc) = CAST(o_totalprice AS DECIMAL(18,2)) THEN 'pass' ELSE 'fail' END AS status
FROM s JOIN orders ON o_orderkey = bill_id
"""


def date_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dated before the claim, or over five years after it, one row per violated predicate."""
    both = views.documents(spark, sf_dir).join(views.claims(spark, sf_dir).select("claim_id", "stated_on"), "claim_id")
    found = F.array_compact(F.array(
        F.when(F.col("dated") < F.col("stated_on"), "sequence:dated_before_claim"),
        F.when(F.date_add("stated_on", 1825) < F.col("dated"), "sequence:dated_long_after"),
    ))
    return both.select("claim_id", F.col("line").cast("bigint").alias("line"), "dated", F.explode(found).alias("subject"))


DATE_SEQUENCE = """
WITH b AS (SELECT l_orderkey AS claim_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_shipdate AS DATE) AS dated, CAST(o_orderdate AS DATE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT claim_id, line, dated, 'sequence:dated_before_claim' AS subject FROM b WHERE dated < s
UNION ALL SELECT claim_id, line, dated, 'sequence:dated_long_after' FROM b WHERE s + 1825 < dated
"""


def form_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the claim form that differ from what the customer record states, in long form."""
    people = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    form = views.claims(spark, sf_dir).join(people, F.col("owner") == F.col("c_custkey")).select(
        "claim_id", F.col("status").alias("form_status"), F.col("priority").alias("form_priority"),
        F.when(F.col("c_nationkey") < 10, "F").otherwise("O").alias("record_status"), F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").otherwise("5-LOW").alias("record_priority"),
    )
    long = form.select("claim_id", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"form_{k}").alias("stated"), F.col(f"record_{k}").alias("expected")) for k in ("status", "priority")))).alias("f")).select("claim_id", "f.*")
    return long.filter(~F.col("stated").eqNullSafe(F.col("expected")))


FORM_MISMATCH = """
WITH f AS (SELECT o_orderkey AS claim_id, o_orderstatus AS s, o_orderpriority AS p, CASE WHEN c_nationkey < 10 THEN 'F' ELSE 'O' END AS es, CASE WHEN c_mktsegment = 'BUILDING' THEN '1-URGENT' ELSE '5-LOW' END AS ep FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT claim_id, 'status' AS field, s AS stated, es AS expected FROM f WHERE s IS DISTINCT FROM es UNION ALL SELECT claim_id, 'priority', p, ep FROM f WHERE p IS DISTINCT FROM ep
"""


def duplicate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill numbers (owner and day) used by two or more bills, and whether their totals differ."""
    number = F.concat_ws("-", F.col("owner"), F.date_format("stated_on", "yyyyMM"))
    found = views.claims(spark, sf_dir).groupBy(number.alias("number")).agg(F.count("*").alias("n_bills"), F.min("claim_id").alias("first_bill"), F.min("total").alias("low"), F.max("total").alias("high"))
    return found.filter("n_bills >= 2").select("number", "n_bills", "first_bill", (F.col("low") != F.col("high")).alias("totals_differ"))


DUPLICATE_NUMBERS = """
SELECT o_custkey || '-' || strftime(o_orderdate, '%Y%m') AS number, count(*) AS n_bills, min(o_orderkey) AS first_bill,
  min(CAST(o_totalprice AS DECIMAL(18,2))) <> max(CAST(o_totalprice AS DECIMAL(18,2))) AS totals_differ FROM orders GROUP BY 1 HAVING count(*) >= 2
"""


def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a claim's pages: per code the first severity and the sorted pages."""
    flags = views.documents(spark, sf_dir).filter("discount >= 0.09").select("claim_id", F.concat(F.lit("code_"), "doc_type").alias("code"), "line", F.when(F.col("quantity") > 25, "review").otherwise("info").alias("severity"))
    rolled = flags.groupBy("claim_id", "code").agg(F.min(F.struct("line", "severity")).alias("first"), F.sort_array(F.collect_set("line")).alias("pages"))
    return rolled.select("claim_id", "code", F.col("first.severity").alias("severity"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


QUALITY_ROLLUP = """
WITH f AS (SELECT l_orderkey AS claim_id, 'code_' || l_returnflag || l_linestatus AS code, l_linenumber AS line, CASE WHEN l_quantity > 25 THEN 'review' ELSE 'info' END AS severity FROM lineitem WHERE l_discount >= 0.09)
SELECT claim_id, code, arg_min(severity, lpad(CAST(line AS VARCHAR), 4, '0') || severity) AS severity, array_to_string(list_sort(list_distinct(list(line))), ',') AS pages FROM f GROUP BY ALL
"""


def claim_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim with ``findings``, an array of (rank, code, subject, charged): each of missing_required and date_sequence once, in this order.

    ``charged``: the checklist charges what is missing already, unless the requirement does not apply.  Lines and claims are
    reduced to flags and extremes by claim before they meet, so nothing has to be made distinct or numbered afterwards.
    """
    has = lambda types: F.max(F.col("doc_type").isin(*types))
    lines = views.documents(spark, sf_dir).groupBy("claim_id").agg(F.min("dated").alias("low"), F.max("dated").alias("high"), *(has(ts).alias(f"has_{k}") for k, ts in REQUIRED.items()))
    open_ = F.max(~F.coalesce(F.col("status") == "F", F.lit(False))).alias("open")
    claims = views.claims(spark, sf_dir).groupBy("claim_id").agg(F.min("stated_on").alias("first"), F.max("stated_on").alias("last"), open_)
    finding = lambda rank, code, subject, charged: F.struct(F.lit(rank).alias("rank"), F.lit(code).alias("code"), F.lit(subject).alias("subject"), charged.alias("charged"))
    found = [F.when(~F.coalesce(f"has_{k}", F.lit(False)), finding(0, "R001", f"requirement:{k}", F.col("open") if k == "consent" else F.lit(True))) for k in sorted(REQUIRED)]
    found.append(F.when(F.col("low") < F.col("last"), finding(1, "R008", "sequence:dated_before_claim", F.lit(False))))
    found.append(F.when(F.date_add("first", 1825) < F.col("high"), finding(1, "R008", "sequence:dated_long_after", F.lit(False))))
    whole = claims.join(lines, "claim_id", "left").select("claim_id", F.array_sort(F.array_compact(F.array(*found))).alias("findings"))
    return whole.filter("claim_id is not null and size(findings) > 0")


def check_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per claim: outcome of the checks, the codes that failed and the most serious severity."""
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f.code))), ",")
    severity = F.element_at(F.array(F.lit("critical"), F.lit("review")), F.col("findings")[0]["rank"] + 1)
    prints = F.transform("findings", lambda f: F.substring(F.sha2(F.concat_ws("|", f.code, f.subject), 256), 1, 40))
    return claim_findings(spark, sf_dir).select("claim_id", F.size("findings").cast("bigint").alias("n_findings"), codes.alias("codes"), severity.alias("severity"), F.array_min(prints).alias("first_fingerprint"))


CHECK_PAYLOAD = f"""
WITH m AS ({MISSING_REQUIRED}), d AS ({DATE_SEQUENCE}), r AS (SELECT DISTINCT claim_id, code, rank, substr(sha256(code || '|' || subject), 1, 40) AS fp FROM (SELECT claim_id, 'R001' AS code, 0 AS rank, subject FROM m UNION ALL SELECT claim_id, 'R008', 1, subject FROM d))
SELECT claim_id, count(*) AS n_findings, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes, CASE min(rank) WHEN 0 THEN 'critical' ELSE 'review' END AS severity, min(fp) AS first_fingerprint FROM r GROUP BY 1
"""

CATALOGUE = {
    "canonical_vote": (canonical_vote, CANONICAL_VOTE),
    "competing_values": (competing_values, COMPETING_VALUES),
    "value_variants": (value_variants, VALUE_VARIANTS),
    "mode_tiebreak": (mode_tiebreak, MODE_TIEBREAK),
    "missing_required": (missing_required, MISSING_REQUIRED),
    "requirement_status": (requirement_status, REQUIREMENT_STATUS),
    "line_arithmetic": (line_arithmetic, LINE_ARITHMETIC),
    "subtotal_check": (subtotal_check, SUBTOTAL_CHECK),
    "total_check": (total_check, TOTAL_CHECK),
    "date_sequence": (date_sequence, DATE_SEQUENCE),
    "form_mismatch": (form_mismatch, FORM_MISMATCH),
    "duplicate_numbers": (duplicate_numbers, DUPLICATE_NUMBERS),
    "quality_rollup": (quality_rollup, QUALITY_ROLLUP),
    "check_payload": (check_payload, CHECK_PAYLOAD),
}
