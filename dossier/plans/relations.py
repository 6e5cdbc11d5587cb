"""Queries over relations of findings, what rules say, whole states compared and digested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import changes, checklist, rules
from dossier.plans.checks import REQUIREMENT_STATUS, requirement_status
from dossier.sources.tables import table

REQUIREMENTS = {"bill": ("NO", "AF"), "consent": ("RF",), "note": ("RF", "NF"), "report": ("AF", "XX")}
RAISED_FOR = {"billing": ("NO",), "surgery": ("RF", "NF"), "nothing": ()}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_quantity")


def _severity(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, checklist.SEVERITIES)), (n % 4 + 1).cast("int"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of lines with much tax, each naming two lines of its claim; and of claims, naming what they ask for."""
    part = F.col("l_partkey")
    of_lines = _lines(spark, sf_dir).filter("l_tax > 0.06").select(
        F.col("l_orderkey").alias("claim_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"), F.concat(F.lit("R"), (part % 5).cast("string")).alias("rule"), _severity(part).alias("severity"),
        (F.col("l_suppkey") % 3 != 0).alias("active"), F.lit("").alias("subject"), F.array(F.col("l_linenumber").cast("long"), (F.col("l_linenumber") % 4 + 1).cast("long")).alias("document_ids"),
    )
    customer = F.col("o_custkey")
    asked = F.element_at(F.array(*(F.lit(f"requirement:{k}") for k in (*RAISED_FOR, "unknown"))), (customer % 4 + 1).cast("int"))
    of_claims = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("finding_id"), F.lit("R001").alias("rule"), _severity(customer).alias("severity"),
        (customer % 5 != 0).alias("active"), asked.alias("subject"), F.array().cast("array<long>").alias("document_ids"),
    )
    return of_lines.unionByName(of_claims)


def checklist_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist of every claim with what relates to each requirement."""
    claims = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey").withColumnRenamed("o_orderkey", "claim_id")
    documents = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").cast("long").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("doc_type"),
        (F.col("l_discount") < 0.075).alias("usable"), (F.col("l_discount") >= 0.085).alias("excluded"),
    )
    applies = {"consent": F.col("o_orderstatus") != "P", "report": F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 2 == 0)}
    found = checklist.evaluate(claims, documents, _findings(spark, sf_dir), REQUIREMENTS, applies, RAISED_FOR)
    return found.select("claim_id", "requirement", "status", "because", *(F.col(c).cast("long").alias(c) for c in ("n_documents", "n_shadowed", "n_findings")), "first_finding")


def _values(rows: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, vs in rows.items() for v in vs)


_SEVERITY = "[" + ", ".join(f"'{s}'" for s in checklist.SEVERITIES) + "]"
_ASKED = "[" + ", ".join(f"'{k}'" for k in (*RAISED_FOR, "unknown")) + "]"
CHECKLIST_RELATIONS = f"""
WITH bt(requirement, doc_type) AS (VALUES {_values(REQUIREMENTS)}), rf(asked, doc_type) AS (VALUES {_values(RAISED_FOR)}),
docs AS (SELECT l_orderkey AS claim_id, l_linenumber AS doc_id, requirement, l_discount < 0.075 AS usable, l_discount >= 0.085 AS excluded FROM lineitem JOIN bt ON doc_type = l_returnflag || l_linestatus),
fl AS (SELECT l_orderkey AS claim_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 'R' || (l_partkey % 5) AS rule, l_partkey % 4 AS place, l_suppkey % 3 <> 0 AS active, l_linenumber AS n FROM lineitem WHERE l_tax > 0.06),
fc AS (SELECT o_orderkey AS claim_id, 'c' || o_orderkey AS id, 'R001' AS rule, o_custkey % 4 AS place, o_custkey % 5 <> 0 AS active, {_ASKED}[o_custkey % 4 + 1] AS asked FROM orders),
rel AS (
  SELECT DISTINCT f.claim_id, requirement, id, rule, place, active, true AS cites FROM fl f JOIN docs d ON d.claim_id = f.claim_id AND d.usable AND (d.doc_id = f.n OR d.doc_id = f.n % 4 + 1)
  UNION ALL SELECT DISTINCT claim_id, bt.requirement, id, rule, place, active, false FROM fc JOIN rf ON rf.asked = fc.asked JOIN bt ON bt.doc_type = rf.doc_type
), ra AS (
  SELECT claim_id, requirement, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (cites AND active AND place < 2) AS n_open, min(row(NOT active, place, rule, id)) AS first FROM rel GROUP BY ALL
), da AS (SELECT claim_id, requirement, count(*) FILTER (usable) AS n, count(*) FILTER (excluded AND NOT usable) AS shadowed FROM docs GROUP BY ALL),
k AS (SELECT o_orderkey AS claim_id, requirement, CASE requirement WHEN 'consent' THEN o_orderstatus <> 'P' WHEN 'report' THEN o_custkey % 9 <> 0 AND o_custkey % 2 = 0 ELSE true END AS holds FROM orders CROSS JOIN (SELECT DISTINCT requirement FROM bt))
SELECT k.claim_id, k.requirement, CASE WHEN NOT holds THEN 'not_applicable' WHEN da.n > 0 AND n_open > 0 THEN 'review_required' WHEN da.n > 0 THEN 'found' ELSE 'missing' END AS status,
  CASE WHEN NOT holds THEN 'condition' WHEN da.n > 0 AND n_open > 0 THEN 'open_findings' WHEN da.n > 0 THEN 'documents' WHEN shadowed > 0 THEN 'shadowed' ELSE 'absent' END AS because,
  CASE WHEN holds THEN coalesce(da.n, 0) ELSE 0 END AS n_documents, CASE WHEN holds THEN coalesce(shadowed, 0) ELSE 0 END AS n_shadowed, CASE WHEN holds THEN coalesce(ra.n, 0) ELSE 0 END AS n_findings,
  CASE WHEN holds THEN struct_extract(ra.first, 4) END AS first_finding
FROM k LEFT JOIN da ON da.claim_id = k.claim_id AND da.requirement = k.requirement LEFT JOIN ra ON ra.claim_id = k.claim_id AND ra.requirement = k.requirement
"""

REPEATED = rules.Rule("R013", "review", "Part {part} is billed on {n:line} of claim {claim_id}", "required")
EMPTY = rules.Rule("R017", "info", "Claim {claim_id} of {n:line} states no {part}", "none")


def built_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two rules say: parts billed on several lines of a claim, with these as evidence; claims whose every line returned."""
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("claim_id"), (F.col("l_partkey") % 20).alias("part"), F.col("l_linenumber").cast("long").alias("line"), "l_returnflag")
    often = lines.groupBy("claim_id", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("evidence")).filter("n > 1")
    one = rules.build(often.withColumn("subject", F.concat(F.lit("part:"), F.col("part").cast("string"))), REPEATED, "claim_id")
    all_returned = lines.groupBy("claim_id").agg(F.count("*").alias("n"), F.min(F.col("l_returnflag") == "R").alias("all")).filter("all")
    two = rules.build(all_returned.withColumn("part", F.lit(None).cast("string")).withColumn("subject", F.lit("claim")).withColumn("evidence", F.array().cast("array<long>")), EMPTY, "claim_id")
    return one.unionByName(two).select("claim_id", "rule", "severity", "subject", "wording", F.array_join("evidence", ",").alias("evidence"), "fingerprint")


BUILT_FINDINGS = """
WITH o AS (SELECT l_orderkey AS claim_id, l_partkey % 20 AS part, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS evidence FROM lineitem GROUP BY ALL HAVING count(*) > 1),
a AS (SELECT l_orderkey AS claim_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R'))
SELECT claim_id, 'R013' AS rule, 'review' AS severity, 'part:' || part AS subject, 'Part ' || part || ' is billed on ' || n || ' lines of claim ' || claim_id AS wording, evidence, sha256('R013|part:' || part) AS fingerprint FROM o
UNION ALL SELECT claim_id, 'R017', 'info', 'claim', 'Claim ' || claim_id || ' of ' || n || CASE WHEN n = 1 THEN ' line' ELSE ' lines' END || ' states no ', '', sha256('R017|claim') FROM a
"""


def _entity(rows: DataFrame, kind: str, key: Column, label: Column, state: Column, excluded: Column | None = None) -> DataFrame:
    shut = F.lit(False) if excluded is None else excluded
    return rows.select("claim_id", F.lit(kind).alias("kind"), key.cast("string").alias("key"), label.alias("label"), state.alias("state"), shut.alias("excluded"))


_STATUSES = ("open", "auto_closed", "resolved", "reopened")


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The state of every claim before and after a pass; every fifth claim had none before."""
    lines = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "claim_id").withColumn("line", F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").withColumnRenamed("o_orderkey", "claim_id")
    items = requirement_status(spark, sf_dir)
    status = lambda n: F.element_at(F.array(*map(F.lit, _STATUSES)), (n % 4 + 1).cast("int"))
    c, part, supp = F.col("o_custkey"), F.col("l_partkey"), F.col("l_suppkey")

    def state(then: bool) -> DataFrame:
        excluded = F.col("l_discount") >= (0.095 if then else 0.075)
        documents = _entity(lines.filter("l_linenumber % 3 <> 0") if then else lines, "document", F.col("line"), F.col("line"), F.concat("l_returnflag", "l_linestatus"), excluded)
        findings = _entity(lines.filter("l_tax > 0.05") if then else lines.filter("l_tax > 0.04"), "finding", F.col("line"), F.lit("tax"), status(part if then else part + F.floor(supp % 3 / 2)))
        now = F.when((F.col("claim_id") % 2 == 0) & (F.col("state") == "found"), "missing").otherwise(F.col("state")) if then else F.col("state")
        listed = _entity(items, "checklist", F.col("requirement"), F.col("requirement"), now)
        value = F.when(c % 4 != 0, F.col("o_orderpriority")) if then else F.when(c % 7 != 0, F.col("o_orderpriority"))
        fields = _entity(orders, "canonical", F.lit("priority"), F.lit("Priority"), value).unionByName(_entity(orders, "canonical", F.lit("status"), F.lit("Status"), F.col("o_orderstatus")))
        asked = items.filter("n_documents = 0")
        questions = _entity(asked.filter("claim_id % 3 = 0") if then else asked, "question", F.col("requirement"), F.col("requirement"), F.when(F.col("claim_id") % 4 == 0, "resolved").otherwise("open") if not then else F.lit("open"))
        procedure = F.when(c % 6 != 0, F.concat(F.lit("p"), (c % 5).cast("string"))) if then else F.when(c % 8 != 0, F.concat(F.lit("p"), (c % 25 % 6).cast("string")))
        whole = documents
        for part_of in (findings, listed, fields, questions, _entity(orders, "procedure", F.lit("procedure"), F.lit("Procedure"), procedure)):
            whole = whole.unionByName(part_of)
        return whole.filter("claim_id % 5 <> 0") if then else whole

    return state(True), state(False)


def change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in every claim."""
    return changes.diff(*_states(spark, sf_dir))


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine counters a claim."""
    before, after = _states(spark, sf_dir)
    return changes.summary(changes.diff(before, after), after)


def _status_sql(n: str) -> str:
    return "[" + ", ".join(f"'{s}'" for s in _STATUSES) + f"][({n}) % 4 + 1]"


_LINE = "concat_ws('/', l_linenumber, l_partkey, l_suppkey)"
_CHANGES = f"""
i AS ({REQUIREMENT_STATUS}),
l AS (SELECT l_orderkey AS claim_id, {_LINE} AS key, max(l_returnflag || l_linestatus) AS type, max(CAST(l_discount >= 0.075 AS INT)) AS shut, max(CAST(l_discount >= 0.095 AS INT)) AS was_shut, l_linenumber % 3 <> 0 AND l_orderkey % 5 <> 0 AS known,
  bool_or(l_tax > 0.04) AS raised, bool_or(l_tax > 0.05) AND l_orderkey % 5 <> 0 AS stood, l_partkey AS p, l_suppkey AS s FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
o AS (SELECT o_orderkey AS claim_id, o_orderkey % 5 <> 0 AS seen, CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority END AS was, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS now,
  CASE WHEN o_custkey % 6 <> 0 THEN 'p' || (o_custkey % 5) END AS was_p, CASE WHEN o_custkey % 8 <> 0 THEN 'p' || (o_custkey % 25 % 6) END AS now_p FROM orders),
c AS (
  SELECT claim_id, 'document' AS kind, key, key AS label, CASE WHEN known THEN 'in the claim' END AS "before", CASE WHEN known THEN 'excluded as a duplicate' ELSE type END AS "after", NOT known AS new FROM l WHERE NOT known OR (shut = 1 AND was_shut = 0)
  UNION ALL SELECT claim_id, 'finding', key, 'tax', CASE WHEN stood THEN {_status_sql('p')} END, {_status_sql('p + (s % 3) // 2')}, NOT stood FROM l WHERE raised AND claim_id % 5 <> 0 AND (NOT stood OR (s % 3) // 2 <> 0)
  UNION ALL SELECT claim_id, 'checklist', requirement, requirement, 'missing', 'found', false FROM i WHERE claim_id % 5 <> 0 AND claim_id % 2 = 0 AND state = 'found'
  UNION ALL SELECT claim_id, 'canonical', 'priority', 'Priority', was, now, false FROM o WHERE seen AND was IS DISTINCT FROM now
  UNION ALL SELECT claim_id, 'question', requirement, requirement, CASE WHEN claim_id % 3 = 0 AND claim_id % 5 <> 0 THEN 'open' END, CASE WHEN claim_id % 4 = 0 THEN 'resolved' ELSE 'open' END, NOT (claim_id % 3 = 0 AND claim_id % 5 <> 0)
    FROM i WHERE n_documents = 0 AND (NOT (claim_id % 3 = 0 AND claim_id % 5 <> 0) OR claim_id % 4 = 0)
  UNION ALL SELECT claim_id, 'procedure', 'procedure', 'Procedure', was_p, now_p, false FROM o WHERE seen AND was_p IS DISTINCT FROM now_p
)"""
CHANGE_LIST = f"WITH {_CHANGES} SELECT * FROM c"
CHANGE_SUMMARY = f"""
WITH {_CHANGES}, t AS (
  SELECT claim_id, count(*) AS changes, count(*) FILTER (kind = 'document' AND new) AS documents_added, count(*) FILTER (kind = 'finding' AND "after" IN ('open', 'reopened') AND coalesce("before", '') NOT IN ('open', 'reopened')) AS findings_opened,
    count(*) FILTER (kind = 'finding' AND "after" = 'auto_closed') AS findings_auto_closed, count(*) FILTER (kind = 'question' AND new) AS questions_asked, count(*) FILTER (kind = 'question' AND "after" = 'resolved') AS questions_resolved,
    count(*) FILTER (kind = 'checklist') AS checklist_changed, count(*) FILTER (kind = 'canonical') AS canonical_changed FROM c GROUP BY 1
), u AS (SELECT claim_id, count(*) FILTER (state IN ('missing', 'review_required')) AS outstanding_requirements FROM i GROUP BY 1)
SELECT u.claim_id, outstanding_requirements, COLUMNS(t.* EXCLUDE (claim_id)) FROM u LEFT JOIN t ON t.claim_id = u.claim_id
"""
CHANGE_SUMMARY = CHANGE_SUMMARY.replace("COLUMNS(t.* EXCLUDE (claim_id))", ", ".join(f"coalesce(t.{c}, 0) AS {c}" for c in ("changes", "documents_added", "findings_opened", "findings_auto_closed", "questions_asked", "questions_resolved", "checklist_changed", "canonical_changed")))


def state_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each claim's nested state that does not depend on the order of its documents or keys."""
    lines = _lines(spark, sf_dir)
    document = F.struct(F.col("l_returnflag").alias("type"), F.col("l_linenumber").cast("long").alias("line"), F.create_map(F.lit("supp"), F.col("l_suppkey").cast("long"), F.lit("part"), F.col("l_partkey").cast("long")).alias("refs"))
    nested = lines.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_list(document).alias("documents"))
    whole = nested.select("claim_id", F.struct("documents", F.lit(None).cast("string").alias("form"), F.col("claim_id").alias("claim")).alias("state"))
    return whole.select("claim_id", changes.digest(whole, "state").alias("state_sha256"))


STATE_DIGESTS = """
WITH d AS (SELECT l_orderkey AS claim_id, '{"line":' || l_linenumber || ',"refs":{"part":' || l_partkey || ',"supp":' || l_suppkey || '},"type":"' || l_returnflag || '"}' AS j FROM lineitem)
SELECT claim_id, sha256('{"claim":' || claim_id || ',"documents":[' || string_agg(j, ',' ORDER BY j) || '],"form":null}') AS state_sha256 FROM d GROUP BY claim_id
"""

CATALOGUE = {
    "checklist_relations": (checklist_relations, CHECKLIST_RELATIONS),
    "built_findings": (built_findings, BUILT_FINDINGS),
    "change_list": (change_list, CHANGE_LIST),
    "change_summary": (change_summary, CHANGE_SUMMARY),
    "state_digests": (state_digests, STATE_DIGESTS),
}
