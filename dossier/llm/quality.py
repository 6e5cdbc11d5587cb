"""Operator 5: quality rules by a hashed n-gram likelihood ratio.  DataFrame functions only.

Words and pairs of words are hashed to buckets, at least BUCKETS and more with the
root of the corpus' bytes, as its vocabulary grows.  Two multinomials over the buckets are counted, that of
the raw corpus over all documents and that of a trusted target; a document's score is the mean logarithm
of their ratio over its n-grams, and it is kept if the score reaches a threshold.  The trusted target is
every document labelled quality 1: one half of them, by a hash of the id, is counted, the threshold is an exact low
quantile of the other half's scores, so that what resembles trusted text stays.  Base rules on length and repetition come first.

Counts are pre-aggregated in each task; they go to every executor up to BROADCAST buckets and are joined
beyond.  Documents are scored by a sum that is pre-aggregated too, whatever their length.  Repeated windows
are found by their whole 64-bit hashes.

Defined results: null and blank texts have no words and fail the base rules; without trusted rows every
document that passes them is kept; rows sharing a doc_id, repeated ones too, are judged one by one, and a label
of their id counts for each; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import NO_ID, Scratch, numbered, read, words

BUCKETS = 1 << 16
#: Bytes of text that BUCKETS are for.
BYTES = 1 << 26
#: Buckets, and ids of trusted documents, up to which they go to every executor.
BROADCAST = 1 << 22
#: Share of trusted documents below the threshold.
QUANTILE = 0.001
MIN_WORDS = 50
#: Most repeated words, in per cent of the words.
MOST_REPEATED = 50
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, twin, the base features and ``w``, the array of words.

    Three-word windows become (hash, place) in one sorted array, in which neighbours with one hash are repeats.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", "twin", words(F.col("text")).alias("w"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"), lines.alias("lines"))
    window = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p"))
    windows = F.when(F.size("w") > 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window))
    third = first.select(
        "doc_id", "twin", "w", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.sort_array(windows).alias("keys")
    )
    both = F.zip_with("keys", F.slice("keys", 2, F.size("keys")), lambda x, y: F.when(x.h == y.h, F.array(x.p, y.p)))
    fourth = third.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.array_compact(both)))))
    # a window at p adds min(3, p - the one before) words
    covered = F.aggregate("places", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)
    return fourth.select(
        "doc_id", "twin", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "w",
    )


def buckets_for(size: int) -> int:
    """A power of two that grows with the root of the bytes of all texts."""
    return BUCKETS << max(0, math.ceil(math.log2(max(1, size) / BYTES) / 2))


def hashed(w: str, buckets: int) -> Column:
    """Buckets of the words and pairs of words of array column ``w``."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda x, y: bucket(x, y))
    return F.concat(F.transform(w, lambda x: bucket(x)), pairs)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ratios(docs: DataFrame, trusted: DataFrame, scratch: Scratch, buckets: int) -> DataFrame:
    """bucket, llr: the logarithm of target over raw probability, counted over all of docs and of ``trusted`` (doc_id)."""
    marked = docs.join(trusted.withColumn("target", F.lit(1)), "doc_id", "left")
    grams = marked.select(F.coalesce("target", F.lit(0)).alias("target"), F.explode(hashed("w", buckets)).alias("bucket"))
    counts = scratch.write(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")), "counts")
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target = float(raw or 0), float(target or 0)
    seen = (F.col("raw") + 1) / F.lit(raw + buckets)
    return counts.select("bucket", F.ln((F.col("target") + buckets * seen) / F.lit(target + buckets) / seen).alias("llr"))


def exact_quantile(scores: DataFrame, quantile: float) -> float | None:
    """The least score that ``quantile`` of all scores do not exceed; null if there are none.

    An approximate quantile with a margin bounds it from below, so that few scores beyond are put in order.
    """
    known = scores.filter("score is not null").select("score")
    n, low = known.agg(F.count("*"), F.percentile_approx("score", F.lit(max(quantile - 2e-5, 0.0)), F.lit(100_000))).first()
    if not n:
        return None
    rank = max(1, math.ceil(quantile * n))
    below = known.filter(F.col("score") < F.lit(low)).count()
    known, rank = (known.filter(F.col("score") >= F.lit(low)), rank - below) if below < rank else (known, rank)
    return known.orderBy("score").limit(rank).agg(F.max("score")).first()[0]


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the base features, base_failed, score, kept of every row."""
    scratch = Scratch(docs.sparkSession)
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if good.count() <= BROADCAST:
        good = F.broadcast(good)
    half = F.expr("pmod(xxhash64(doc_id, 1), 2)")
    buckets = buckets_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    docs = with_features(numbered(docs))
    llr = ratios(docs.select("doc_id", "w"), good.filter(half == 0), scratch, buckets)
    grams = docs.select("doc_id", "twin", *FEATURES, F.explode_outer(hashed("w", buckets)).alias("bucket"))
    scored = grams.join(F.broadcast(llr) if buckets <= BROADCAST else llr, "bucket", "left").groupBy("doc_id", "twin", *FEATURES).agg(F.avg("llr").alias("score"))
    scored = scratch.write(scored.withColumn("base_failed", base_failed()), "scored")
    fair = scored.filter("not base_failed").join(good.filter(half == 1), "doc_id", "left_semi")
    threshold = exact_quantile(fair, quantile)
    kept = ~F.col("base_failed") if threshold is None else ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= F.lit(threshold))
    return scored.select(F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), *FEATURES, "base_failed", "score", kept.alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base features, base_failed, kept, and the score."""
    return judged(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
