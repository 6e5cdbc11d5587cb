"""Queries over layouts, folds, state and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.operators import claims as views
from dossier.operators import folds, state
from dossier.plans.checks import MISSING_REQUIRED, REQUIREMENT_STATUS, missing_required, requirement_status
from dossier.sources.tables import table

ORDER = "ORDER BY ts, event_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")


def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside the stream of each user (file): errors read as nothing; values over 5 name themselves."""
    pages = _events(spark, sf_dir).withColumn("page", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    return folds.segments(pages.withColumn("named", (F.col("value") > 5) & (F.col("event_type") != "error")), "user_id", "page", "event_type", "named")


SEGMENT_SPANS = f"""
WITH RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id {ORDER}) AS page, event_type AS type, value > 5 AND event_type <> 'error' AS named FROM events),
f AS (
  SELECT user_id, page, CAST(0 AS BIGINT) AS segment, type AS open_type, CAST(0 AS BIGINT) AS amb FROM p WHERE page = 1
  UNION ALL
  SELECT p.user_id, p.page, f.segment + CASE WHEN p.named AND p.type <> f.open_type THEN 1 ELSE 0 END, CASE WHEN p.named AND p.type <> f.open_type THEN p.type ELSE f.open_type END,
    CAST(CASE WHEN NOT (p.named AND p.type <> f.open_type) AND p.type <> f.open_type THEN 1 ELSE 0 END AS BIGINT)
  FROM f JOIN p ON p.user_id = f.user_id AND p.page = f.page + 1
)
SELECT user_id, segment, min(page) AS first_page, max(page) AS last_page, min(open_type) AS segment_type, CAST(sum(amb) AS BIGINT) AS n_ambiguous FROM f GROUP BY user_id, segment
"""


def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page counts of segments by type."""
    spans = segment_spans(spark, sf_dir)
    return spans.groupBy("segment_type").agg(F.count("*").alias("n_segments"), F.sum(F.col("last_page") - F.col("first_page") + 1).alias("n_pages"))


def cells_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (cells): runs of a user's events with no gap over 20 minutes."""
    rows = _events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    rows = rows.withColumn("before", F.lag("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    found = folds.islands(rows, "user_id", ["ts", "event_id"], F.col("t") - F.col("before") > 1200)
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).select("user_id", F.col("island").cast("bigint").alias("island"), "n", "first_event")


CELLS_ISLANDS = f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id {ORDER})),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id {ORDER} ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY user_id, island
"""


def anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of each user: sorted values cluster within 2.5 of a cluster's first."""
    return folds.anchored_clusters(_events(spark, sf_dir).filter("value is not null"), "user_id", "value", 2.5)


ANCHOR_CLUSTERS = """
WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events WHERE value IS NOT NULL),
f AS (
  SELECT user_id, k, value AS anchor, CAST(0 AS BIGINT) AS cluster FROM p WHERE k = 1
  UNION ALL SELECT p.user_id, p.k, CASE WHEN p.value - f.anchor > 2.5 THEN p.value ELSE f.anchor END, f.cluster + CASE WHEN p.value - f.anchor > 2.5 THEN 1 ELSE 0 END
  FROM f JOIN p ON p.user_id = f.user_id AND p.k = f.k + 1
)
SELECT user_id, cluster, min(anchor) AS anchor, count(*) AS n FROM f GROUP BY user_id, cluster
"""


def hash_hamming_pairs(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Pairs of vectors of one label whose 63-bit difference hashes differ in few bits: one of most+1 bands must be equal.

    Vectors of the table are far apart, so every tenth one is joined by a scan of its own (id -1 - vec_id) with one number negated.
    """
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    negated = F.transform("embedding", lambda x, i: F.when(i == F.col("at"), -x).otherwise(x))
    scans = vectors.filter("vec_id % 10 = 0").withColumn("at", F.col("vec_id") % 64).select((-1 - F.col("vec_id")).alias("vec_id"), "label", negated.alias("embedding"))
    vectors = vectors.unionByName(scans)
    bits = " | ".join(f"shiftleft(cast(embedding[{i + 1}] > embedding[{i}] as bigint), {i})" for i in range(63))
    hashed = vectors.select("vec_id", "label", F.expr(bits).alias("h"))
    width = -(-63 // (most + 1))
    keyed = hashed.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("key", F.expr(f"shiftrightunsigned(h, band * {width}) & {(1 << width) - 1}L"))
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.vec_id") < F.col("y.vec_id")))
    distance = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h")))
    return pairs.filter(distance <= most).select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), distance.cast("bigint").alias("distance")).distinct()


_BITS = " | ".join(f"(CAST(embedding[{i + 2}] > embedding[{i + 1}] AS BIGINT) << {i})" for i in range(62)) + " | (CASE WHEN embedding[64] > embedding[63] THEN 4611686018427387904 ELSE 0 END)"
HASH_HAMMING = f"""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings
  UNION ALL SELECT -1 - vec_id, label, list_transform(embedding, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 10 = 0),
h AS (SELECT vec_id, label, {_BITS} AS h FROM e)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.h, y.h)) AS BIGINT) AS distance FROM h x JOIN h y ON x.label = y.label AND x.vec_id < y.vec_id WHERE bit_count(xor(x.h, y.h)) <= 3
"""

MOVES = {
    "view": (("open", "reopened"), "acknowledged"),
    "click": (("open", "reopened", "acknowledged"), "resolved"),
    "error": (("resolved", "acknowledged", "auto_closed"), "reopened"),
    "purchase": (("open", "reopened"), "auto_closed"),
}


def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each user's finding after all its actions, with the refused ones counted."""
    return folds.lifecycle(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "open", MOVES)


_ALLOWED = " ".join(f"WHEN p.event_type = '{n}' AND f.status IN ({', '.join(repr(x) for x in src)}) THEN '{to}'" for n, (src, to) in MOVES.items())
LIFECYCLE_FOLD = f"""
WITH RECURSIVE p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id {ORDER}) AS k FROM events), u AS (SELECT DISTINCT user_id FROM p),
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS k, 'open' AS status, CAST(0 AS BIGINT) AS refused FROM u
  UNION ALL SELECT p.user_id, p.k, coalesce(CASE {_ALLOWED} END, f.status), f.refused + CASE WHEN CASE {_ALLOWED} END IS NULL THEN 1 ELSE 0 END FROM f JOIN p ON p.user_id = f.user_id AND p.k = f.k + 1
)
SELECT user_id, arg_max(status, k) AS status, arg_max(refused, k) AS refused, max(k) AS n_actions FROM f GROUP BY 1
"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of an earlier pass: of two claims in three, with statuses by their number."""
    status = F.element_at(F.array(*map(F.lit, ("open", "auto_closed", "resolved", "acknowledged", "reopened"))), (F.col("claim_id") % 5 + 1).cast("int"))
    return views.claims(spark, sf_dir).filter("claim_id % 3 <> 0").select("claim_id", status.alias("status"), (F.col("claim_id") % 4 + 1).alias("occurrences"))


_STORED = "s AS (SELECT o_orderkey AS claim_id, ['open', 'auto_closed', 'resolved', 'acknowledged', 'reopened'][o_orderkey % 5 + 1] AS status, o_orderkey % 4 + 1 AS occ FROM orders WHERE o_orderkey % 3 <> 0)"


def finding_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of the findings, given what the required-document check raises now."""
    return state.reconcile(_stored(spark, sf_dir), missing_required(spark, sf_dir), "claim_id", F.col("claim_id") % 2 == 0)


FINDING_RECONCILE = f"""
WITH r AS (SELECT DISTINCT claim_id FROM ({MISSING_REQUIRED})), {_STORED},
b AS (SELECT coalesce(s.claim_id, r.claim_id) AS claim_id, status, occ, r.claim_id IS NOT NULL AS raised FROM s FULL JOIN r ON s.claim_id = r.claim_id),
c AS (SELECT *, CASE WHEN status IS NULL THEN 'created' WHEN raised AND status = 'auto_closed' THEN 'reopened' WHEN NOT raised AND status IN ('open', 'reopened') THEN 'auto_closed' ELSE 'kept' END AS change FROM b)
SELECT claim_id, CASE change WHEN 'created' THEN 'open' WHEN 'kept' THEN status ELSE change END AS status,
  CAST(coalesce(occ, 1) + CASE WHEN raised AND status IS NOT NULL AND claim_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS occurrences, change FROM c
"""


def question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks, resolutions and withdrawals for the checklists of all claims."""
    questions = requirement_status(spark, sf_dir).filter("claim_id % 3 <> 0").select("claim_id", "requirement", F.when(F.col("claim_id") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return state.question_plan(requirement_status(spark, sf_dir).select("claim_id", "requirement", "state"), questions, ["claim_id", "requirement"])


QUESTION_PLAN = f"""
WITH i AS ({REQUIREMENT_STATUS}), b AS (SELECT claim_id, requirement, state, CASE WHEN claim_id % 3 <> 0 THEN CASE WHEN claim_id % 2 = 0 THEN 'open' ELSE 'resolved' END END AS q FROM i)
SELECT * FROM (SELECT claim_id, requirement, CASE WHEN state IN ('found', 'review_required') THEN CASE WHEN q <> 'resolved' THEN 'resolve' END WHEN state = 'missing' THEN CASE WHEN q IS NULL THEN 'ask' END WHEN q = 'open' THEN 'withdraw' END AS todo FROM b) WHERE todo IS NOT NULL
"""


def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between an earlier pass (two claims in three, urgent ones seen as low) and now."""
    now = views.claims(spark, sf_dir).select("claim_id", "status", "priority")
    before = now.filter("claim_id % 3 <> 0").withColumn("priority", F.when(F.col("priority") == "1-URGENT", "5-LOW").otherwise(F.col("priority")))
    return state.changes(before, now, "claim_id", "status", "priority")


STATE_DIFF = """
WITH a AS (SELECT o_orderkey AS claim_id, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 3 <> 0 AS known FROM orders)
SELECT claim_id, 'status' AS field, CAST(NULL AS VARCHAR) AS before, s AS after, 'new' AS kind FROM a WHERE NOT known
UNION ALL SELECT claim_id, 'priority', NULL, p, 'new' FROM a WHERE NOT known
UNION ALL SELECT claim_id, 'priority', '5-LOW', p, 'changed' FROM a WHERE known AND p = '1-URGENT'
"""


def _deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing requirements cost 12 (4 if documented as unavailable), reviews 8; findings are not charged."""
    items = requirement_status(spark, sf_dir)
    told = F.col("claim_id") % 7 == 0
    missing = items.filter("state = 'missing'").select("claim_id", F.when(told, 4).otherwise(12).alias("amount"), (~told).alias("missing"), F.lit(False).alias("attention"))
    review = items.filter("state = 'review_required'").select("claim_id", F.lit(8).alias("amount"), F.lit(False).alias("missing"), F.lit(True).alias("attention"))
    return missing.unionByName(review)


def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and status of every claim; one without documents scores the floor."""
    read = views.documents(spark, sf_dir).select("claim_id").distinct().withColumn("read", F.lit(True))
    claims = views.claims(spark, sf_dir).select("claim_id").join(read, "claim_id", "left").withColumn("read", F.coalesce("read", F.lit(False)))
    return state.readiness(claims, _deductions(spark, sf_dir), "claim_id").withColumn("deducted", F.col("deducted").cast("bigint"))


READINESS_SCORE = f"""
WITH i AS ({REQUIREMENT_STATUS}), d AS (
  SELECT claim_id, sum(CASE state WHEN 'missing' THEN CASE WHEN claim_id % 7 = 0 THEN 4 ELSE 12 END WHEN 'review_required' THEN 8 ELSE 0 END) AS deducted,
    count(*) FILTER (state = 'missing' AND claim_id % 7 <> 0) AS missing, count(*) FILTER (state = 'review_required') AS attention FROM i GROUP BY 1
), r AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT claim_id, CAST(CASE WHEN l_orderkey IS NULL THEN 0 ELSE greatest(0, 100 - deducted) END AS BIGINT) AS score, CAST(deducted AS BIGINT) AS deducted,
  CASE WHEN l_orderkey IS NULL OR missing > 0 THEN 'incomplete' WHEN attention > 0 THEN 'needs_attention' ELSE 'ready_for_human_review' END AS status
FROM d LEFT JOIN r ON l_orderkey = claim_id
"""


def readiness_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by status with the range of their scores, and whether they can be approved."""
    rows = readiness_score(spark, sf_dir)
    return rows.groupBy("status", (F.col("status") == "ready_for_human_review").alias("can_be_approved")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current step of each claim's workflow."""
    ready, claims = readiness_score(spark, sf_dir), views.claims(spark, sf_dir).select("claim_id", F.col("status").alias("claim_status"))
    step = F.when(F.col("score") == 0, "read documents").when(F.col("status") == "incomplete", "complete documents").when(F.col("status") == "needs_attention", "review findings").when(F.col("claim_status") == "F", "done").otherwise("approve")
    return ready.join(claims, "claim_id").select("claim_id", step.alias("step"))


def input_hash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims to evaluate again: their inputs' hash is not the stored one."""
    now = views.claims(spark, sf_dir)
    stored = now.filter("claim_id % 4 <> 0").withColumn("status", F.when(F.col("claim_id") % 10 == 1, "X").otherwise(F.col("status")))
    stored = stored.withColumn("input_hash", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("status", "priority"))), 256))
    return state.unchanged(now, stored, "claim_id", "status", "priority").select("claim_id", "input_hash")


INPUT_HASH_GATE = "SELECT o_orderkey AS claim_id, sha256(o_orderstatus || '|' || o_orderpriority) AS input_hash FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 1"


def approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last approval (purchase) and whether an error after it superseded it."""
    rows = _events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error"))
    last = rows.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("approved"), F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).alias("changed"))
    return last.filter("approved is not null").select("user_id", F.col("approved.event_id").alias("approval"), F.coalesce(F.col("changed") > F.col("approved"), F.lit(False)).alias("superseded"))


APPROVAL = """
WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id AS approval, EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND event_type = 'error' AND (e.ts > p.ts OR (e.ts = p.ts AND e.event_id > p.event_id))) AS superseded FROM p
"""


def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside raw pages against the words that pages have as links: resolved or not, per page."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    cited = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="/([a-z]+)"'), F.lit(1)))).alias("target"))
    known = table(spark, sf_dir, "benchmark", "text").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("target")).distinct().withColumn("known", F.lit(1))
    return cited.join(known, "target", "left").groupBy("page_id").agg(F.count("*").alias("n_cited"), F.count("known").alias("n_resolved"))


CITATION_RESOLVE = """
WITH c AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="/([a-z]+)"', 1))) AS target FROM pages), k AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS target FROM benchmark)
SELECT page_id, count(*) AS n_cited, count(k.target) AS n_resolved FROM c LEFT JOIN k USING (target) GROUP BY 1
"""


def report_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON report per claim: facts, checklist in order and readiness, with a content hash."""
    items = requirement_status(spark, sf_dir).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("requirement", "state", "n_documents"))).alias("checklist"))
    facts = views.claims(spark, sf_dir).join(items, "claim_id").join(readiness_score(spark, sf_dir).withColumnRenamed("status", "readiness"), "claim_id")
    payload = F.to_json(F.struct("claim_id", "owner", F.col("stated_on").cast("string").alias("stated_on"), "status", F.col("total").cast("string").alias("total"), "checklist", "score", "readiness"))
    return facts.select("claim_id", payload.alias("payload"), F.sha2(payload, 256).alias("content_hash"))


CATALOGUE = {
    "segment_spans": (segment_spans, SEGMENT_SPANS),
    "segment_pages": (segment_pages, f"SELECT segment_type, count(*) AS n_segments, CAST(sum(last_page - first_page + 1) AS BIGINT) AS n_pages FROM ({SEGMENT_SPANS}) GROUP BY 1"),
    "cells_islands": (cells_islands, CELLS_ISLANDS),
    "anchor_clusters": (anchor_clusters, ANCHOR_CLUSTERS),
    "hash_hamming_pairs": (hash_hamming_pairs, HASH_HAMMING),
    "lifecycle_fold": (lifecycle_fold, LIFECYCLE_FOLD),
    "finding_reconcile": (finding_reconcile, FINDING_RECONCILE),
    "question_plan": (question_plan, QUESTION_PLAN),
    "state_diff": (state_diff, STATE_DIFF),
    "readiness_score": (readiness_score, READINESS_SCORE),
    "readiness_ladder": (readiness_ladder, f"SELECT status, status = 'ready_for_human_review' AS can_be_approved, count(*) AS n, min(score) AS low, max(score) AS high FROM ({READINESS_SCORE}) GROUP BY ALL"),
    "workflow_steps": (workflow_steps, f"SELECT claim_id, CASE WHEN score = 0 THEN 'read documents' WHEN r.status = 'incomplete' THEN 'complete documents' WHEN r.status = 'needs_attention' THEN 'review findings' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'approve' END AS step FROM ({READINESS_SCORE}) r JOIN orders ON o_orderkey = claim_id"),
    "input_hash_gate": (input_hash_gate, INPUT_HASH_GATE),
    "approval": (approval, APPROVAL),
    "citation_resolve": (citation_resolve, CITATION_RESOLVE),
    "report_payload": (report_payload, None),
}
