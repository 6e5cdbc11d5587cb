"""The canonical claim: fields voted over what its documents state, the named checks, sections, conditions, steps and the whole state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.operators import folds
from dossier.operators.ranking import vote
from dossier.plans.checks import REQUIREMENT_STATUS, requirement_status
from dossier.plans.workflow import READINESS_SCORE, readiness_score
from dossier.sources.tables import table

#: Check -> (rule, severity, the fields it compares).
NAMED = {
    "patient_name": ("R003", "review", ("patient",)),
    "uhid": ("R004", "review", ("uhid",)),
    "admission_date": ("R006", "review", ("admission",)),
    "discharge_date": ("R007", "review", ("discharge",)),
    "diagnosis": ("R009", "review", ("diagnosis",)),
    "doctors": ("R011", "review", ("surgeon", "anaesthetist")),
}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_tax")


def _numbered(prefix: str, column: str, n: int) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) % n).cast("string"))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of what each document states: claim_id, field, normal, weight, eligible, confidence; fields it does not state are no rows."""
    flag = F.col("l_returnflag")
    fields = {
        "patient": _numbered("patient ", "l_suppkey", 2),
        "uhid": _numbered("u", "l_partkey", 3),
        "admission": F.when(flag == "N", F.date_format("l_shipdate", "yyyy-MM")),
        "discharge": F.when(flag == "R", F.date_format("l_shipdate", "yyyy")),
        "diagnosis": F.when(F.col("l_linestatus") == "O", F.lower(flag)),
        "surgeon": F.when(flag == "A", _numbered("dr ", "l_suppkey", 2)),
        "anaesthetist": F.when(flag == "R", _numbered("dr ", "l_linenumber", 2)),
        "procedure": F.when(flag != "A", _numbered("p", "l_partkey", 5)),
    }
    listed = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("normal")) for k, v in fields.items()))
    # lines are dealt out by claim once, before they become many rows: votes and what follows them need no other shuffle
    dealt = _rows(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return dealt.select(
        F.col("l_orderkey").alias("claim_id"), F.explode(F.filter(listed, lambda f: f.normal.isNotNull())).alias("f"),
        F.when(F.col("l_linenumber") <= 3, 3).otherwise(1).alias("weight"), (F.col("l_discount") < 0.08).alias("eligible"), (1 - F.col("l_discount")).alias("confidence"),
    ).select("claim_id", "f.field", "f.normal", "weight", "eligible", "confidence")


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote(stated(spark, sf_dir), "claim_id", "field")


_VOTED = """
base AS (
  SELECT *, l_orderkey AS claim_id, CASE WHEN l_linenumber <= 3 THEN 3 ELSE 1 END AS weight, l_discount < 0.08 AS eligible, 1 - l_discount AS confidence FROM lineitem
), st AS (
  SELECT claim_id, 'patient' AS field, 'patient ' || (l_suppkey % 2) AS normal, weight, eligible, confidence FROM base
  UNION ALL SELECT claim_id, 'uhid', 'u' || (l_partkey % 3), weight, eligible, confidence FROM base
  UNION ALL SELECT claim_id, 'admission', strftime(l_shipdate, '%Y-%m'), weight, eligible, confidence FROM base WHERE l_returnflag = 'N'
  UNION ALL SELECT claim_id, 'discharge', strftime(l_shipdate, '%Y'), weight, eligible, confidence FROM base WHERE l_returnflag = 'R'
  UNION ALL SELECT claim_id, 'diagnosis', lower(l_returnflag), weight, eligible, confidence FROM base WHERE l_linestatus = 'O'
  UNION ALL SELECT claim_id, 'surgeon', 'dr ' || (l_suppkey % 2), weight, eligible, confidence FROM base WHERE l_returnflag = 'A'
  UNION ALL SELECT claim_id, 'anaesthetist', 'dr ' || (l_linenumber % 2), weight, eligible, confidence FROM base WHERE l_returnflag = 'R'
  UNION ALL SELECT claim_id, 'procedure', 'p' || (l_partkey % 5), weight, eligible, confidence FROM base WHERE l_returnflag <> 'A'
), ta AS (
  SELECT claim_id, field, normal, CAST(coalesce(sum(weight) FILTER (eligible), 0) AS BIGINT) AS weight, count(*) FILTER (eligible) AS n_eligible, count(*) AS n_sources, max(confidence) FILTER (eligible) AS confidence
  FROM st WHERE normal IS NOT NULL GROUP BY ALL
), vo AS (
  SELECT *, row_number() OVER (PARTITION BY claim_id, field ORDER BY n_eligible > 0 DESC, weight DESC, n_eligible DESC, confidence DESC NULLS LAST, normal) AS rank FROM ta
), na(check_name, rule, severity, field) AS (VALUES """ + ", ".join(f"('{k}', '{r}', '{s}', '{f}')" for k, (r, s, fs) in NAMED.items() for f in fs) + ")"


def _named(spark: SparkSession) -> DataFrame:
    rows = [(k, r, s, f) for k, (r, s, fs) in NAMED.items() for f in fs]
    return F.broadcast(spark.createDataFrame(rows, "check_name string, rule string, severity string, field string"))


def named_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of single fields raise: every value stated against the chosen one, with its subject."""
    voted = _voted(spark, sf_dir)
    best = F.max(F.when(F.col("n_eligible") > 0, F.struct(-F.col("rank"), "normal"))).over(Window.partitionBy("claim_id", "field"))
    against = voted.withColumn("best", best).filter("best is not null and rank > 1").join(_named(spark), "field")
    return against.select("claim_id", "rule", "severity", F.concat_ws(":", "field", "normal").alias("subject"), F.col("best.normal").alias("chosen"), "n_sources")


NAMED_FINDINGS = f"""
WITH {_VOTED}
SELECT v.claim_id, rule, severity, v.field || ':' || v.normal AS subject, b.normal AS chosen, v.n_sources
FROM vo v JOIN vo b ON b.claim_id = v.claim_id AND b.field = v.field AND b.rank = 1 AND b.n_eligible > 0 JOIN na ON na.field = v.field WHERE v.rank > 1
"""


def _by_claim(voted: DataFrame, *more: Column) -> DataFrame:
    """One row per claim with values: whether a field has an eligible one, how many values it has, and ``more``."""
    fields = [f for _, _, of in NAMED.values() for f in of]
    known = [F.max((F.col("field") == f) & (F.col("n_eligible") > 0)).alias(f"known_{f}") for f in fields]
    return voted.groupBy("claim_id").agg(*known, *(F.count_if(F.col("field") == f).alias(f"values_{f}") for f in fields), *more)


def _outcomes() -> Column:
    """The checks of a claim (its row by ``_by_claim``, or none): check_name, status, n_findings."""
    found = []
    for name, (_, _, of) in NAMED.items():
        known = [F.coalesce(f"known_{f}", F.lit(False)) for f in of]
        n = sum((F.when(k, F.col(f"values_{f}") - 1).otherwise(0) for k, f in zip(known, of, strict=True)), F.lit(0)).cast("bigint")
        status = F.when(~F.greatest(F.lit(False), *known), "pending").when(n > 0, "failed").otherwise("passed")
        found.append(F.struct(F.lit(name).alias("check_name"), status.alias("status"), n.alias("n_findings")))
    return F.array(*found)


def named_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every such check for every claim: pending where no document gives an eligible value, failed where values compete."""
    claims = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("claim_id"))
    both = claims.join(_by_claim(_voted(spark, sf_dir)), "claim_id", "left")
    return both.select("claim_id", F.explode(_outcomes()).alias("c")).select("claim_id", "c.*")


NAMED_CHECKS = f"""
WITH {_VOTED}, by_field AS (SELECT claim_id, check_name, bool_or(n_eligible > 0) AS known, count(*) - 1 AS others FROM vo JOIN na USING (field) GROUP BY claim_id, check_name, field),
t AS (SELECT claim_id, check_name, bool_or(known) AS known, CAST(sum(CASE WHEN known THEN others ELSE 0 END) AS BIGINT) AS n FROM by_field GROUP BY ALL)
SELECT o_orderkey AS claim_id, c.check_name, CASE WHEN known IS NOT TRUE THEN 'pending' WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, coalesce(n, 0) AS n_findings
FROM orders CROSS JOIN (SELECT DISTINCT check_name FROM na) c LEFT JOIN t ON t.claim_id = o_orderkey AND t.check_name = c.check_name
"""


def procedures_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The procedures that a claim's documents state, the chosen one first; each later one is a finding of its own (R010)."""
    voted = _voted(spark, sf_dir).filter("field = 'procedure'")
    rule = F.when(F.col("rank") > 1, "R010")
    return voted.select("claim_id", F.col("rank").cast("bigint").alias("place"), F.col("normal").alias("procedure"), F.col("chosen").alias("selected"), "n_sources", rule.alias("rule"))


PROCEDURES_SECTION = f"WITH {_VOTED} SELECT claim_id, rank AS place, normal AS procedure, rank = 1 AND n_eligible > 0 AS selected, n_sources, CASE WHEN rank > 1 THEN 'R010' END AS rule FROM vo WHERE field = 'procedure'"


def declared_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The procedure in force: documents win, else what was declared (two claims in three); a declaration that documents contradict is superseded."""
    chosen = _voted(spark, sf_dir).filter("field = 'procedure' and chosen").select("claim_id", F.col("normal").alias("documented"))
    return _declared(spark, sf_dir).join(chosen, "claim_id", "left").select(
        "claim_id", *_in_force(), F.coalesce(F.col("documented") != F.col("declared"), F.lit(False)).alias("superseded")
    )


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("claim_id"), declared.alias("declared"))


def _in_force() -> tuple[Column, Column]:
    origin = F.when(F.col("documented").isNotNull(), "documents").when(F.col("declared").isNotNull(), "declaration").otherwise("unknown")
    return F.coalesce("documented", "declared").alias("procedure"), origin.alias("origin")


DECLARED_PROCEDURE = f"""
WITH {_VOTED}, k AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'p' || (o_custkey % 5) END AS declared, normal AS documented
  FROM orders LEFT JOIN (SELECT * FROM vo WHERE field = 'procedure' AND rank = 1 AND n_eligible > 0) d ON d.claim_id = o_orderkey)
SELECT claim_id, coalesce(documented, declared) AS procedure, CASE WHEN documented IS NOT NULL THEN 'documents' WHEN declared IS NOT NULL THEN 'declaration' ELSE 'unknown' END AS origin,
  coalesce(documented <> declared, false) AS superseded FROM k
"""


def bills_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values voted inside each bill (claim and line; its pages repeat it): quantity and tax with how many pages agree."""
    listed = F.array(F.struct(F.lit("quantity").alias("field"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("normal")), F.struct(F.lit("tax").alias("field"), F.col("l_tax").cast("decimal(18,2)").cast("string").alias("normal")))
    rows = _rows(spark, sf_dir).select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").cast("bigint").alias("bill"), F.explode(listed).alias("f"), F.lit(1).alias("weight"), (F.col("l_discount") < 0.08).alias("eligible"), (1 - F.col("l_discount")).alias("confidence")
    ).select("claim_id", "bill", "f.field", "f.normal", "weight", "eligible", "confidence")
    won = vote(rows, "claim_id", "bill", "field").filter("chosen")
    return won.select("claim_id", "bill", "field", F.col("normal").alias("value"), "n_eligible", "n_sources")


BILLS_SECTION = """
WITH r AS (SELECT l_orderkey AS claim_id, CAST(l_linenumber AS BIGINT) AS bill, l_discount < 0.08 AS eligible, 1 - l_discount AS confidence, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS tax FROM lineitem),
u AS (UNPIVOT r ON quantity, tax INTO NAME field VALUE value),
t AS (SELECT claim_id, bill, field, value, count(*) FILTER (eligible) AS n_eligible, count(*) AS n_sources, max(confidence) FILTER (eligible) AS c FROM u GROUP BY ALL)
SELECT claim_id, bill, field, value, n_eligible, n_sources FROM t WHERE n_eligible > 0 QUALIFY row_number() OVER (PARTITION BY claim_id, bill, field ORDER BY n_eligible DESC, c DESC NULLS LAST, value) = 1
"""


def operative_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an operative note (type RF) is there and another document names its part: pending without a note, no findings."""
    note = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    parts = _rows(spark, sf_dir).groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey") % 10).agg(F.max(note).alias("noted"), F.max(~note).alias("elsewhere"))
    found = parts.groupBy("claim_id").agg(F.max("noted").alias("noted"), F.max(F.col("noted") & F.col("elsewhere")).alias("corroborated"))
    claims = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("claim_id"))
    return claims.join(found, "claim_id", "left").select("claim_id", F.when(F.col("noted"), "passed").otherwise("pending").alias("status"), F.coalesce("corroborated", F.lit(False)).alias("corroborated"))


OPERATIVE_DOCUMENTATION = """
WITH n AS (SELECT l_orderkey AS k, l_partkey % 10 AS p, l_returnflag = 'R' AND l_linestatus = 'F' AS note FROM lineitem)
SELECT o_orderkey AS claim_id, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.k = o_orderkey AND note) THEN 'passed' ELSE 'pending' END AS status,
  EXISTS (SELECT 1 FROM n a JOIN n b ON a.k = b.k AND a.p = b.p WHERE a.k = o_orderkey AND a.note AND NOT b.note) AS corroborated FROM orders
"""


def checklist_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conditional requirements stand: implant papers if an implant is billed, anaesthesia record unless all that is stated is local (unknown: stands)."""
    billed = F.col("l_quantity") >= 45
    local = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") % 2 == 0)
    facts = _rows(spark, sf_dir).groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.max(billed).alias("billed"), F.max(local).alias("some_local"), F.max(~local).alias("some_general"))
    claims = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("claim_id"))
    false = F.lit(False)
    only_local = F.coalesce("some_local", false) & ~F.coalesce("some_general", false)
    item = lambda name, stands, note: F.struct(F.lit(name).alias("requirement"), stands.alias("stands"), F.when(~stands, note).alias("note"))
    items = F.array(
        item("claim form", F.lit(True), F.lit(None).cast("string")),
        item("implant papers", F.coalesce("billed", false), F.lit("no implant is billed")),
        item("anaesthesia record", ~only_local, F.lit("anaesthesia is local")),
    )
    return claims.join(facts, "claim_id", "left").select("claim_id", F.explode(items).alias("i")).select("claim_id", "i.*")


CHECKLIST_CONDITIONS = """
WITH x AS (
  SELECT o_orderkey AS claim_id, count(*) FILTER (l_quantity >= 45) AS billed, count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 2 = 0) AS loc, count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 2 = 1) AS gen
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
)
SELECT claim_id, 'claim form' AS requirement, true AS stands, NULL AS note FROM x
UNION ALL SELECT claim_id, 'implant papers', billed > 0, CASE WHEN billed = 0 THEN 'no implant is billed' END FROM x
UNION ALL SELECT claim_id, 'anaesthesia record', loc = 0 OR gen > 0, CASE WHEN loc > 0 AND gen = 0 THEN 'anaesthesia is local' END FROM x
"""

SEVEN = ("documents", "processing", "validation", "checklist", "questions", "readiness", "review")


def workflow_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven steps of every claim, each pending, current or complete; documents at a discount of 0.10 are still being read, a claim of status F was approved."""
    docs = _rows(spark, sf_dir).groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") >= 0.0999).alias("unread"))
    items = requirement_status(spark, sf_dir).groupBy("claim_id").agg(F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "review_required").alias("asked"))
    claims = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderstatus") == "F").alias("closed"))
    ready = readiness_score(spark, sf_dir).select("claim_id", (F.col("status") == "ready_for_human_review").alias("ready"))
    all_of = claims.join(docs, "claim_id", "left").na.fill(0, ["n", "unread"]).join(items, "claim_id").join(ready, "claim_id")
    processed, state = F.col("n") > F.col("unread"), lambda done, now: F.when(done, "complete").when(now, "current").otherwise("pending")
    states = [
        state(F.col("n") > 0, F.lit(True)), state((F.col("n") > 0) & (F.col("unread") == 0), F.col("n") > 0), state(processed & (F.col("unread") == 0), processed),
        state(processed & (F.col("missing") == 0), processed), state(processed & (F.col("asked") == 0), processed), state(F.col("ready"), processed),
        state(F.col("ready") & F.col("closed"), F.col("ready")),
    ]
    steps = F.array(*(F.struct(F.lit(k + 1).cast("bigint").alias("place"), F.lit(s).alias("step"), c.alias("state")) for k, (s, c) in enumerate(zip(SEVEN, states, strict=True))))
    return all_of.select("claim_id", F.explode(steps).alias("s")).select("claim_id", "s.*")


WORKFLOW_SEVEN = f"""
WITH d AS (SELECT l_orderkey AS claim_id, count(*) AS n, count(*) FILTER (l_discount >= 0.0999) AS unread FROM lineitem GROUP BY 1),
i AS (SELECT claim_id, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'review_required') AS asked FROM ({REQUIREMENT_STATUS}) GROUP BY 1),
r AS (SELECT claim_id, status = 'ready_for_human_review' AS ready FROM ({READINESS_SCORE})),
a AS (SELECT o_orderkey AS claim_id, o_orderstatus = 'F' AS closed, coalesce(n, 0) AS n, coalesce(unread, 0) AS unread, missing, asked, ready FROM orders LEFT JOIN d ON d.claim_id = o_orderkey JOIN i ON i.claim_id = o_orderkey JOIN r ON r.claim_id = o_orderkey),
w AS (SELECT *, n > unread AS got FROM a)
SELECT claim_id, 1::BIGINT AS place, 'documents' AS step, CASE WHEN n > 0 THEN 'complete' ELSE 'current' END AS state FROM w
UNION ALL SELECT claim_id, 2, 'processing', CASE WHEN n = 0 THEN 'pending' WHEN unread = 0 THEN 'complete' ELSE 'current' END FROM w
UNION ALL SELECT claim_id, 3, 'validation', CASE WHEN NOT got THEN 'pending' WHEN unread = 0 THEN 'complete' ELSE 'current' END FROM w
UNION ALL SELECT claim_id, 4, 'checklist', CASE WHEN NOT got THEN 'pending' WHEN missing = 0 THEN 'complete' ELSE 'current' END FROM w
UNION ALL SELECT claim_id, 5, 'questions', CASE WHEN NOT got THEN 'pending' WHEN asked = 0 THEN 'complete' ELSE 'current' END FROM w
UNION ALL SELECT claim_id, 6, 'readiness', CASE WHEN ready THEN 'complete' WHEN got THEN 'current' ELSE 'pending' END FROM w
UNION ALL SELECT claim_id, 7, 'review', CASE WHEN ready AND closed THEN 'complete' WHEN ready THEN 'current' ELSE 'pending' END FROM w
"""


def claim_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim with its sections put together: chosen values, procedure and its origin, failed checks, what is missing, readiness."""
    chosen = lambda f, name: F.max(F.when(F.col("chosen") & (F.col("field") == f), F.col("normal"))).alias(name)
    sections = ("patient", "uhid", "admission", "discharge", "diagnosis")
    stated_by = _by_claim(_voted(spark, sf_dir), chosen("procedure", "documented"), *(chosen(f, f) for f in sections))
    ended = lambda status: F.size(F.filter(_outcomes(), lambda c: c.status == status)).cast("bigint")
    whole = _declared(spark, sf_dir).join(stated_by, "claim_id", "left").select("claim_id", *_in_force(), *sections, ended("failed").alias("n_failed"), ended("pending").alias("n_pending"))
    lacking = requirement_status(spark, sf_dir).groupBy("claim_id").agg(F.count_if(F.col("state") == "missing").alias("n_missing"))
    ready = readiness_score(spark, sf_dir).select("claim_id", "score", F.col("status").alias("readiness"))
    return whole.join(lacking, "claim_id").join(ready, "claim_id")


CLAIM_STATE = f"""
WITH {_VOTED}, ch AS (SELECT * FROM vo WHERE rank = 1 AND n_eligible > 0), nc AS ({NAMED_CHECKS}), pr AS ({DECLARED_PROCEDURE}), ri AS ({REQUIREMENT_STATUS}), re AS ({READINESS_SCORE}),
cf AS (SELECT claim_id, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'pending') AS n_pending FROM nc GROUP BY 1),
cm AS (SELECT claim_id, count(*) FILTER (state = 'missing') AS n_missing FROM ri GROUP BY 1)
SELECT p.claim_id, p.procedure, p.origin, a.normal AS patient, b.normal AS uhid, c.normal AS admission, d.normal AS discharge, e.normal AS diagnosis, n_failed, n_pending, n_missing, re.score, re.status AS readiness
FROM pr p LEFT JOIN ch a ON a.claim_id = p.claim_id AND a.field = 'patient' LEFT JOIN ch b ON b.claim_id = p.claim_id AND b.field = 'uhid'
LEFT JOIN ch c ON c.claim_id = p.claim_id AND c.field = 'admission' LEFT JOIN ch d ON d.claim_id = p.claim_id AND d.field = 'discharge' LEFT JOIN ch e ON e.claim_id = p.claim_id AND e.field = 'diagnosis'
JOIN cf ON cf.claim_id = p.claim_id JOIN cm ON cm.claim_id = p.claim_id JOIN re ON re.claim_id = p.claim_id
"""


def bundle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found inside bundles (the events of a user are its pages) by page counters, types and identifiers, with why each begins."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    k = F.col("event_id")
    pages = events.select(
        F.col("user_id").alias("file"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("page"), F.col("event_type").alias("type"),
        (F.col("value") > 5).alias("named"), F.when(k % 4 == 0, F.create_map(F.lit("ref"), (k % 3).cast("string"))).alias("identifiers"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, 1).otherwise(2)).alias("at"), F.when(k % 5 == 0, F.lit(2)).alias("total"),
    )
    return folds.placed_segments(pages)


BUNDLE_DOCUMENTS = """
WITH RECURSIVE p AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, coalesce(event_type, 'other') AS type, coalesce(value > 5, false) AS named,
    CASE WHEN event_id % 4 = 0 THEN event_id % 3 END AS ref, CASE WHEN event_id % 5 = 0 THEN 1 + event_id % 2 END AS pos FROM events
), f AS (
  SELECT user_id, page, CAST(0 AS BIGINT) AS segment, 'first_page' AS because, CASE WHEN named THEN type ELSE 'other' END AS open_type, ref AS open_ref, pos IS NOT NULL AS counted, 1 AS n FROM p WHERE page = 1
  UNION ALL
  SELECT user_id, page, segment + CASE WHEN begins THEN 1 ELSE 0 END, because,
    CASE WHEN begins THEN CASE WHEN named THEN type ELSE 'other' END WHEN open_type = 'other' AND named THEN type ELSE open_type END,
    CASE WHEN begins THEN ref ELSE coalesce(open_ref, ref) END, CASE WHEN begins THEN pos IS NOT NULL ELSE counted OR pos IS NOT NULL END, CASE WHEN begins THEN 1 ELSE n + 1 END
  FROM (
    SELECT *, because IN ('counter_restarted', 'type_changed', 'identifier_changed') AS begins FROM (
      SELECT p.user_id, p.page, p.type, p.named, p.ref, p.pos, f.segment, f.open_type, f.open_ref, f.counted, f.n,
        CASE WHEN pos = 2 OR (pos = 1 AND counted AND n < 2) THEN 'counter' WHEN pos = 1 THEN 'counter_restarted' WHEN named AND type <> open_type THEN 'type_changed'
          WHEN ref <> open_ref THEN 'identifier_changed' WHEN ref = open_ref THEN 'same_identifier' WHEN named OR (type <> 'other' AND type = open_type) THEN 'same_type' ELSE 'ambiguous' END AS because
      FROM f JOIN p ON p.user_id = f.user_id AND p.page = f.page + 1
    )
  )
)
SELECT CAST(user_id AS VARCHAR) AS file, segment, min(page) AS first_page, max(page) AS last_page, max(because) FILTER (because IN ('first_page', 'counter_restarted', 'type_changed', 'identifier_changed')) AS because,
  count(*) FILTER (because = 'ambiguous') AS n_ambiguous, count(*) FILTER (because = 'ambiguous') > 0 AS uncertain FROM f GROUP BY user_id, segment
"""

CATALOGUE = {
    "named_findings": (named_findings, NAMED_FINDINGS),
    "named_checks": (named_checks, NAMED_CHECKS),
    "procedures_section": (procedures_section, PROCEDURES_SECTION),
    "declared_procedure": (declared_procedure, DECLARED_PROCEDURE),
    "bills_section": (bills_section, BILLS_SECTION),
    "operative_documentation": (operative_documentation, OPERATIVE_DOCUMENTATION),
    "checklist_conditions": (checklist_conditions, CHECKLIST_CONDITIONS),
    "workflow_seven": (workflow_seven, WORKFLOW_SEVEN),
    "claim_state": (claim_state, CLAIM_STATE),
    "bundle_documents": (bundle_documents, BUNDLE_DOCUMENTS),
}
