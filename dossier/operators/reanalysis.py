"""Incremental re-analysis: only keys whose inputs changed are computed again, and merged into the published result.

A key's inputs are known by a fingerprint that does not depend on their order: the number of rows and the sum of their
hashes.  The fingerprint is published with the result, in one version, so that both always fit.  Inputs are dealt out by
key once: fingerprints, what has changed and an analysis that groups by the key need no other shuffle of them.  The
inputs of one key are one task's rows, read as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.sources.publish import Published


def fingerprints(inputs: DataFrame, key: str) -> DataFrame:
    """key, fingerprint."""
    row = F.xxhash64(*(c for c in inputs.columns if c != key), *(F.col(c).isNull() for c in inputs.columns if c != key))
    other = F.hash(*(c for c in inputs.columns if c != key))
    sums = inputs.groupBy(key).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.sum(other.cast("bigint")).alias("t"))
    return sums.select(key, F.concat_ws(":", "n", "s", "t").alias("fingerprint"))


def changed(inputs: DataFrame, store: Published, version: int) -> tuple[DataFrame, DataFrame]:
    """Keys whose inputs differ from those of a published version, with their fingerprint; keys that have no inputs any more."""
    now = fingerprints(inputs, store.key)
    if not version:
        return now, now.limit(0).select(store.key)
    seen = store.current(version, [F.get_json_object(store.payload, "$.fingerprint").alias("seen")], inputs.schema[store.key].dataType).drop("version")
    differs = now.join(seen, store.key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("seen"))).select(store.key, "fingerprint")
    return differs, seen.join(now, store.key, "left_anti").select(store.key)


def refresh(inputs: DataFrame, store: Published, analyse: Callable[[DataFrame], DataFrame]) -> int | None:
    """Brings the published result of ``analyse`` (inputs of some keys -> one row per key) up to date; its version, or None.

    ``analyse`` is given the inputs of changed keys only.  Keys that have no inputs any more are taken away.
    """
    base = max((v for v, _ in store.commits()), default=0)
    dealt = inputs.repartition(store.key)
    todo, gone = changed(dealt, store, base)
    # nothing is published yet: all keys are new
    found = analyse(dealt.join(todo.select(store.key), store.key, "left_semi") if base else dealt)
    result = F.struct(*(c for c in found.columns if c != store.key)).alias("result")
    both = todo.join(found.select(store.key, result), store.key, "left")
    payload = F.to_json(F.struct("fingerprint", "result"), {"ignoreNullFields": "false"})
    now = both.select(store.key, payload.alias(store.payload)).unionByName(gone.withColumn(store.payload, F.lit(None).cast("string")))
    # another fingerprint is another payload
    return store.publish(now, differs_from=base)


def result(store: Published, schema: str) -> DataFrame:
    """key and the fields of the published result."""
    parsed = F.from_json(store.payload, f"fingerprint string, result struct<{schema}>")["result"]
    return store.current(show=[parsed.alias("result")]).select(store.key, "result.*")
