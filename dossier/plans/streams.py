"""Streaming queries: the result of a run over what there is equals the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.plans.workflow import LIFECYCLE_FOLD, MOVES, ORDER
from dossier.streaming.events import event_stream, hourly_codes, latest, reconcile_stream, run
from dossier.streaming.questions import question_states


def stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each user's finding after its actions, as far as the watermark has come."""
    found = run(reconcile_stream(event_stream(spark, f"{sf_dir}/events.parquet"), MOVES), spark, "update", "reconcile")
    return latest(found, "user_id").select("user_id", "status", "n_actions")


def stream_hourly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes asked for per user and hour, of the hours that the watermark has closed."""
    found = run(hourly_codes(event_stream(spark, f"{sf_dir}/events.parquet")), spark, "append", "codes")
    return found.selectExpr("user_id", "date_format(hour, 'yyyy-MM-dd HH') AS hour", "n")


def question_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each user, of three kinds, as far as the watermark has come: signups ask, views say yes, clicks say no, purchases upload, errors withdraw."""
    events = event_stream(spark, f"{sf_dir}/events.parquet")
    by_type = lambda **of: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("event_type"))
    said = events.select(
        F.col("user_id").alias("claim"), "event_id", "ts", by_type(signup="ask", view="answer", click="answer", purchase="upload", error="withdraw").alias("action"),
        F.concat(F.lit("r"), F.col("event_id") % 3).alias("requirement"), F.lit("form|letter").alias("expected"), by_type(view="yes", click="not_available", signup="", purchase="", error="").alias("response"),
        F.when(F.col("event_id") % 2 == 0, "lost").alias("reason"), F.concat(F.lit("d"), "event_id").alias("document"), F.when(F.col("value") > 60, "form").otherwise("bill").alias("doc_type"),
    )
    found = latest(run(question_states(said), spark, "update", "questions"), "claim", "requirement")
    return found.select("claim", "requirement", "status", "document", "matched", "n_refused", "n_mismatched")


_DUE = "(SELECT * FROM events WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - 600000)"
QUESTION_LIFECYCLE = f"""
WITH RECURSIVE a AS (SELECT user_id, event_id % 3 AS r, event_id, event_type, value, ts FROM {_DUE}),
b AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN (ts, event_id) END) OVER (PARTITION BY user_id, r) AS asked FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, r {ORDER}) AS k FROM b WHERE (ts, event_id) >= asked),
f AS (
  SELECT user_id, r, k, 'open' AS status, CAST(NULL AS VARCHAR) AS document, CAST(NULL AS BOOLEAN) AS matched, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS mismatched FROM p WHERE k = 1
  UNION ALL
  SELECT p.user_id, p.r, p.k,
    CASE WHEN event_type = 'purchase' AND value > 60 AND status IN ('open', 'answered', 'documented_unavailable') THEN 'resolved' WHEN event_type = 'purchase' AND status = 'open' THEN 'answered'
      WHEN status NOT IN ('open', 'answered') THEN status WHEN event_type = 'error' THEN 'not_applicable' WHEN event_type = 'view' THEN 'answered'
      WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'documented_unavailable' ELSE status END,
    CASE WHEN event_type = 'purchase' THEN 'd' || event_id ELSE document END, CASE WHEN event_type = 'purchase' THEN coalesce(value > 60, false) ELSE matched END,
    refused + CASE WHEN event_type IN ('error', 'view', 'click') AND (status NOT IN ('open', 'answered') OR (event_type = 'click' AND event_id % 2 = 1)) THEN 1 ELSE 0 END,
    mismatched + CASE WHEN event_type = 'purchase' AND NOT coalesce(value > 60, false) THEN 1 ELSE 0 END
  FROM f JOIN p ON p.user_id = f.user_id AND p.r = f.r AND p.k = f.k + 1
)
SELECT user_id AS claim, 'r' || r AS requirement, arg_max(status, k) AS status, arg_max(document, k) FILTER (document IS NOT NULL) AS document, arg_max(matched, k) FILTER (matched IS NOT NULL) AS matched,
  max(refused) AS n_refused, max(mismatched) AS n_mismatched FROM f GROUP BY user_id, r
"""

HOURLY = """
SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events WHERE event_type = 'signup'
GROUP BY user_id, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'signup') - INTERVAL 10 MINUTE
"""

CATALOGUE = {
    "stream_reconcile": (stream_reconcile, f"SELECT user_id, status, n_actions FROM ({LIFECYCLE_FOLD.replace('FROM events', f'FROM {_DUE}')})"),
    "question_lifecycle": (question_lifecycle, QUESTION_LIFECYCLE),
    "stream_hourly_codes": (stream_hourly_codes, HOURLY),
}
