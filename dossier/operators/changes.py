"""Two states of a claim compared as wholes: what changed, counted; and digests of nested states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Kinds of entities, and the statuses in which a finding is open.
KINDS = ("document", "finding", "checklist", "canonical", "question", "procedure")
ACTIVE = ("open", "reopened")
ENTITY = "claim_id, kind, key, label, state, excluded"


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """claim_id, kind, key, label, before, after: every change between two states in long form, from one grouping of all kinds.

    Both states: claim_id, kind, key, label, state (type, status or value), excluded (of documents).  A document is reported
    when it is new or becomes excluded; a finding when it is new, but not in a claim's first pass, or its status changed; a
    question when it is new or changed; a checklist item or a canonical value when it was known and changed; the procedure
    when it changed or went, but not in the first pass.  What else disappeared is not reported.  Null equals null.  Of rows
    that share a key the greatest by label, state and excluded speaks.
    """
    one = F.struct("label", "state", F.coalesce("excluded", F.lit(False)).alias("excluded"))
    rows = before.withColumn("now", F.lit(False)).unionByName(after.withColumn("now", F.lit(True)))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "claim_id")  # dealt out once for all that follows
    both = rows.groupBy("claim_id", "kind", "key").agg(F.max(F.when(F.col("now"), one)).alias("new"), F.max(F.when(~F.col("now"), one)).alias("old"))
    # whether the claim had a state before: from what is grouped already, the state is not read again
    both = both.withColumn("seen", F.col("claim_id").isNotNull() & F.max(F.col("old").isNotNull()).over(Window.partitionBy("claim_id")))
    kind, fresh, moved = F.col("kind"), F.col("old").isNull(), ~F.col("old.state").eqNullSafe(F.col("new.state"))
    shut = (kind == "document") & ~fresh
    told = (
        F.when(kind == "document", fresh | (F.col("new.excluded") & ~F.col("old.excluded")))
        .when(kind == "finding", F.when(fresh, F.col("seen")).otherwise(moved))
        .when(kind == "question", fresh | moved)
        .when(kind == "procedure", F.col("seen") & moved)
        .otherwise(~fresh & moved)
    )
    there = F.col("new").isNotNull() | ((kind == "procedure") & F.col("old").isNotNull())
    return both.filter(there & told).select(
        "claim_id", "kind", "key", F.coalesce("new.label", "old.label").alias("label"),
        F.when(shut, "in the claim").otherwise(F.col("old.state")).alias("before"), F.when(shut, "excluded as a duplicate").otherwise(F.col("new.state")).alias("after"), fresh.alias("new"),
    )


def summary(changes: DataFrame, after: DataFrame) -> DataFrame:
    """Nine counters for every claim of the state after: from its changes, and the requirements outstanding now."""
    kind, now, was = F.col("kind"), F.col("after"), F.col("before")
    opened = now.isin(*ACTIVE) & ~F.coalesce(was.isin(*ACTIVE), F.lit(False))
    counters = {
        "changes": F.lit(True), "documents_added": (kind == "document") & F.col("new"), "findings_opened": (kind == "finding") & opened,
        "findings_auto_closed": (kind == "finding") & (now == "auto_closed"), "questions_asked": (kind == "question") & F.col("new"),
        "questions_resolved": (kind == "question") & (now == "resolved"), "checklist_changed": kind == "checklist", "canonical_changed": kind == "canonical",
    }
    counted = changes.groupBy("claim_id").agg(*(F.count_if(c).alias(name) for name, c in counters.items()))
    outstanding = F.count_if((kind == "checklist") & F.col("state").isin("missing", "review_required")).alias("outstanding_requirements")
    return after.groupBy("claim_id").agg(outstanding).join(counted, "claim_id", "left").na.fill(0, list(counters))


def canonical_json(value: Column, kind: DataType, ordered: bool = False) -> Column:
    """JSON in one form: fields and keys by name, elements of arrays by their own JSON unless ``ordered``; nulls are null."""
    if isinstance(kind, StructType):
        named = [F.concat(F.lit(f'"{f.name}":'), canonical_json(value[f.name], f.dataType, ordered)) for f in sorted(kind, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(_scalar(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType, ordered))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(value), entry)), ","), F.lit("}"))
    elif isinstance(kind, ArrayType):
        listed = F.transform(value, lambda e: canonical_json(e, kind.elementType, ordered))
        text = F.concat(F.lit("["), F.array_join(listed if ordered else F.array_sort(listed), ","), F.lit("]"))
    else:
        return _scalar(value)
    return F.when(value.isNull(), "null").otherwise(text)


def _scalar(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def digest(rows: DataFrame, column: str, ordered: bool = False) -> Column:
    """SHA-256 of a nested column's canonical JSON: equal for states that differ in the order of fields, keys or elements only."""
    return F.sha2(canonical_json(F.col(column), rows.schema[column].dataType, ordered), 256)
