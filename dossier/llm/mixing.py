"""Operator 1: mixing sources to target weights by temperature.  DataFrame functions only.

Source shares of the tokens are raised to an exponent and normalised to weights.  The exponent is
bisected, either to the largest in 0..1 whose weights reach a target entropy (as a share of the greatest
possible one) or to the smallest whose weights repeat no source more often than a limit.  A few steps
of the bisection are one aggregate over the sources, of which the driver sees some numbers.

Weights become token quotas of a budget.  A source is read in epochs, each a fresh permutation of its
documents by a hash, until its quota is full; the last epoch stops at the last document that fits.  The
stream of emissions is cut into blocks: a block takes the same share of each source's quota, so every
block has the target mix, and is permuted inside by a hash.  Running token sums come in two steps, over
buckets of the permutation and inside a bucket, so no window holds a source.

Defined results: a null source is a source; a null or blank text has no tokens and goes along in every
full epoch; a source without tokens is emitted once; rows sharing a doc_id are documents of their own;
an empty table gives no rows.  A limit that no exponent meets gives exponent 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, Scratch, join_checked, numbered, read

#: Parameters of the query.
MAX_EPOCHS = 1.25
BLOCK_TOKENS = 1_000_000
SEED = 17
#: Rows of a bucket aimed at.
BUCKET = 2_000
STEPS = 30
DEPTH = 3


def shuffled(*parts: Column | str) -> Column:
    """A hash to sort by, in hex."""
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def bisect(sources: DataFrame, budget: float | None, max_epochs: float | None, min_entropy: float | None) -> float:
    """The exponent for shares ``p`` of sources; the budget is a share of the tokens there are.

    The middles that the next DEPTH steps can come to are measured in one aggregate.
    """
    p = F.col("p")

    def holding(exponents: list[float]) -> dict[float, bool]:
        own = {t: F.pow("p", F.lit(t)) for t in exponents}
        parts = [F.count("*")]
        for t in exponents:
            parts += [F.sum(own[t]), F.sum(own[t] * F.ln(p)), F.min(own[t] / p), F.max(own[t] / p)]
        n, *rest = sources.filter("p > 0").agg(*parts).first()
        return {t: holds(n, t, *rest[4 * k : 4 * k + 4]) for k, t in enumerate(exponents)}

    def holds(n: int, t: float, z: float | None, plogp: float, lowest: float, highest: float) -> bool:
        if z is None or (min_entropy is not None and n == 1):
            return True
        if min_entropy is not None:
            return math.log(z) - t * plogp / z >= min_entropy * math.log(n)
        # a source is read weight * budget / tokens times; without a budget, the least read one just once
        return (highest / lowest if budget is None else highest / z * budget) <= max_epochs

    ends = holding([0.0, 1.0])
    if min_entropy is not None and ends[1.0]:
        return 1.0
    if min_entropy is None and ends[0.0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS // DEPTH):
        parts = 2**DEPTH
        found = holding([low + (high - low) * k / parts for k in range(1, parts)])
        for _ in range(DEPTH):
            middle = (low + high) / 2  # dyadic, so exactly one of those measured
            # the largest that reaches the entropy, or the smallest that keeps the limit
            low, high = (middle, high) if found[middle] == (min_entropy is not None) else (low, middle)
    return low if min_entropy is not None else high


def quotas(thin: DataFrame, scratch: Scratch, budget_share: float | None, max_epochs: float | None, min_entropy: float | None) -> tuple[DataFrame, int]:
    """name, tokens, rows, quota, weight of each source, and the budget.

    budget_share: tokens to emit over tokens there are; None takes the least budget by which every document is emitted.
    """
    sums = scratch.write(thin.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    t = bisect(shares, budget_share, max_epochs, min_entropy)
    raised = F.when(F.col("p") > 0, F.pow("p", F.lit(t))).otherwise(0.0)
    z, lowest = shares.agg(F.sum(raised), F.min(F.when(F.col("p") > 0, raised / F.col("p")))).first()
    weight = F.round(raised / F.lit(float(z or 1)), 12)
    if budget_share is None:
        budget = int(round(total * (z or 1) / (lowest or 1)))
        quota = F.greatest("tokens", F.round(weight * budget).cast("bigint"))
    else:
        budget = int(total * budget_share)
        quota = F.floor(weight * budget).cast("bigint")
    return scratch.write(shares.select("name", "tokens", "rows", quota.alias("quota"), weight.alias("weight")), "quotas"), budget


def emissions(docs: DataFrame, budget_share: float | None, max_epochs: float | None, min_entropy: float | None, block_tokens: int, seed: int, scratch: Scratch) -> DataFrame:
    """doc_id, twin, source, tokens, epoch, block of every emission."""
    source = F.col("row.source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    thin = numbered(docs).select("doc_id", "twin", F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source)).alias("name"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("tokens"))
    thin = scratch.write(thin, "thin")
    sources, budget = quotas(thin, scratch, budget_share, max_epochs, min_entropy)
    blocks = max(1, -(-budget // block_tokens))
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("rows") / BUCKET))).cast("int").alias("digits")  # 16 buckets to a digit
    of = join_checked(thin, sources.select("name", F.col("tokens").alias("all_tokens"), "quota", digits), ["name"], sources.count())
    full = F.expr("CASE WHEN all_tokens = 0 THEN 1 ELSE quota div all_tokens END")
    of = of.withColumn("full", full).withColumn("rest", F.expr("CASE WHEN all_tokens = 0 THEN 0 ELSE quota % all_tokens END"))
    epochs = F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)
    of = of.filter(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), epochs - 1)))
    of = of.withColumn("key", shuffled(F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string"))).withColumn("bucket", F.substring(F.col("key"), F.lit(1), F.col("digits")))
    group = ["name", "epoch", "bucket"]
    sums = of.groupBy(*group).agg(F.sum("tokens").alias("bucket_tokens"))
    earlier = F.sum("bucket_tokens").over(Window.partitionBy("name", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*group, F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.sum("tokens").over(Window.partitionBy(*group).orderBy("key", "doc_id", "twin").rowsBetween(Window.unboundedPreceding, 0))
    placed = of.withColumn("inside", inside).join(sums, group).withColumn("reached", F.col("earlier") + F.col("inside"))
    placed = placed.filter((F.col("epoch") < F.col("full")) | (F.col("reached") <= F.col("rest")))
    begin = F.col("epoch") * F.col("all_tokens") + F.col("reached") - F.col("tokens")
    size = F.expr(f"greatest(1, (quota + {blocks - 1}) div {blocks})")
    return placed.select("doc_id", "twin", F.when(F.col("name") != "null", F.expr("substring(name, 2)")).alias("source"), "tokens", "epoch", F.floor(begin / size).cast("bigint").alias("block"), "key")


def mix(docs: DataFrame, budget_share: float | None = 1.0, max_epochs: float | None = MAX_EPOCHS, min_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, epoch, block, place: the mixed order is by block, then place."""
    if (max_epochs is None) == (min_entropy is None):
        raise ValueError("give either max_epochs or min_entropy")
    found = emissions(docs, budget_share, max_epochs, min_entropy, block_tokens, seed, Scratch(docs.sparkSession))
    place = F.row_number().over(Window.partitionBy("block").orderBy(shuffled(F.lit(str(seed)), F.col("block").cast("string"), F.col("key")), "doc_id", "twin"))
    return found.select(F.when(F.col("doc_id") < 2**63 - 1, F.col("doc_id")).alias("doc_id"), "source", "tokens", "epoch", "block", (place - 1).cast("bigint").alias("place"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the flattest weights that repeat no source over MAX_EPOCHS times."""
    return mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def mixed_documents(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Every document at least once, those of small sources repeated up to ``max_epochs`` times over: the columns of documents."""
    scratch = Scratch(docs.sparkSession)
    copies = emissions(docs, None, max_epochs, None, BLOCK_TOKENS, seed, scratch).groupBy("doc_id", "twin").agg(F.count("*").cast("int").alias("copies"))
    rows = numbered(docs).join(copies, ["doc_id", "twin"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def oracle(epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> str:
    """The query in DuckDB SQL, with the budget of all tokens."""
    return rf"""
WITH RECURSIVE thin AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents
), sums AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS all_tokens FROM thin GROUP BY source),
shares AS (SELECT *, all_tokens / CAST((SELECT sum(all_tokens) FROM sums) AS DOUBLE) AS p FROM sums),
bisect(k, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN low ELSE middle END, CASE WHEN ok THEN middle ELSE high END FROM (
    SELECT k, low, high, (low + high) / 2 AS middle,
      (SELECT max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) FROM shares) <= {epochs} AS ok FROM bisect WHERE k < {STEPS}
  )
), exponent AS (
  SELECT CASE WHEN (SELECT max(1 / p) / count(*) FROM shares) <= {epochs} THEN 0 ELSE (SELECT high FROM bisect WHERE k = {STEPS}) END AS t
), quotas AS (
  SELECT source, all_tokens, CAST(floor(round(pow(p, t) / sum(pow(p, t)) OVER (), 12) * (SELECT sum(all_tokens) FROM sums)) AS BIGINT) AS quota FROM shares, exponent
), emitted AS (
  SELECT thin.*, all_tokens, quota, unnest(range(CAST(ceil(quota / all_tokens) AS BIGINT))) AS epoch FROM thin JOIN quotas ON thin.source IS NOT DISTINCT FROM quotas.source
), keyed AS (SELECT *, md5('{seed}|' || epoch || '|' || doc_id) AS key FROM emitted),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS reached FROM keyed),
blocks AS (SELECT CAST((sum(all_tokens) + {block_tokens} - 1) // {block_tokens} AS BIGINT) AS n FROM sums),
chosen AS (
  SELECT doc_id, source, tokens, epoch, key, CAST(floor((epoch * all_tokens + reached - tokens) / ((quota + n - 1) // n)) AS BIGINT) AS block
  FROM placed, blocks WHERE epoch < quota // all_tokens OR reached <= quota % all_tokens
)
SELECT doc_id, source, tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY md5('{seed}|' || block || '|' || key), doc_id) - 1 AS place FROM chosen
"""


ORACLE_SQL = oracle()
