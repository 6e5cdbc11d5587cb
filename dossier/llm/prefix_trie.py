r"""Operator 12: the trie of conversation prefixes, built level by level.

The turns of each conversation are numbered; a conversation is rebuilt from the first turns of another one and its own
after them.  Then per depth the live conversations are grouped by (parent node, next turn): a group is a node, and its
least conv_id names it.  A conversation alone in a node leaves the loop, because all nodes below hold only itself: they
are written down at once.  So there are as many levels as the longest prefix that two conversations share has turns.
Joins of a level with the one below, from the deepest up, sum leaves and savings.

A turn is compared by the SHA-256 of its role and text, so texts are read once and never shuffled.  Each level is a
written table: a lost executor costs the level at hand.

Nothing depends on one conversation or one node being small.  Turns are numbered inside ranges of (conv_id, turn) and
the counts of the ranges before are added; groups are counted by partial aggregates; what is known of a node goes to
its conversations by ``join_facts``.  The ids that end in a node are joined in runs of CHUNK, and one task then hashes
the runs of a node in order, as a stream, because SHA-256 can only be taken in order.

Defined results: null roles and texts are empty; a null turn comes first; equal turns are ordered by role and hash
of role and text, repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out;
very long texts are hashed whole; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, Scratch, join_facts, read

CHUNK = 256
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered_turns(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 0, digest, words) and conversations (conv_id, turns)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), role.alias("role"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    ranged = scratch.write(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "ranged")
    here = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a range goes on with at most one conversation of the ranges before it
    begun = here.withColumn("before", before).filter("before is not null").select("conv_id", "part", "before")
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    placed = ranged.withColumn("place", place).join(F.broadcast(begun), ["conv_id", "part"], "left")
    numbered = placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).cast("bigint").alias("pos"), "digest", "words")
    return scratch.write(numbered, "numbered"), here.groupBy("conv_id").agg(F.sum("n").alias("turns"))


def rebuild(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, digest, words, length) and conversations (conv_id, length).

    Conversation c begins with the first h turns of c - c % 20 and goes on with its own after its first h; h is the
    crc32 of the decimal c, modulo 4.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = scratch.write(convs.select("conv_id", "turns", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base")), "found")
    lent = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    length = F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    convs = scratch.write(convs.select("conv_id", "base", "turns", "h", "taken", length.alias("length")), "convs")
    total = convs.agg(F.sum("turns")).first()[0] or 0
    own = join_facts(turns, convs.select("conv_id", "turns", "h", "taken", "length"), ["conv_id"], "turns", total).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words", "length")
    asked = convs.filter("taken > 0").select("conv_id", F.col("base").alias("of"), "taken", "length")
    first = turns.filter("pos < 3").withColumnRenamed("conv_id", "of").join(asked, "of").filter("pos < taken")
    both = own.unionByName(first.select("conv_id", "pos", "digest", "words", "length"))
    # rows in order of pos: a level reads the row groups of its depth
    return scratch.write(both.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos"), "turns"), convs.select("conv_id", "length")


def levels(turns: DataFrame, root: int, scratch: Scratch) -> int:
    """Writes steps/depth=d (conversations with their parent and next turn) and nodes/depth=d; returns the number of levels."""
    spark, depth = turns.sparkSession, 0
    step = turns.filter("pos = 0").select("conv_id", F.lit(root).cast("bigint").alias("node"), "digest", "words", "length")
    while True:
        step = scratch.write(step, f"steps/depth={depth + 1}")
        if not (live := step.count()):
            scratch.drop(f"steps/depth={depth + 1}")
            return depth
        depth += 1
        nodes = scratch.write(
            step.groupBy("node", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("length").alias("length")),
            f"nodes/depth={depth}",
        )
        shared = nodes.filter("n_convs > 1").select("node", "digest", F.col("conv_id").alias("into"), "n_convs")
        moved = join_facts(step.filter(F.col("length") > depth).select("conv_id", "node", "digest"), shared, ["node", "digest"], "n_convs", live)
        following = turns.filter(F.col("pos") == depth).select("conv_id", "digest", "words", "length")
        step = moved.select("conv_id", F.col("into").alias("node")).join(following, "conv_id").select("conv_id", "node", "digest", "words", "length")


def roll_up(spark: SparkSession, depth: int, scratch: Scratch) -> None:
    """Writes totals/depth=d: nodes with their children, leaves and savings, from the deepest level up."""
    below = None
    for d in range(depth, 0, -1):
        nodes = spark.read.parquet(f"{scratch.root}/nodes/depth={d}")
        own = (F.col("n_convs") - 1) * F.col("words")
        if below is None:
            nodes = nodes.select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("children", "leaves", "saved")))
        else:
            nodes = nodes.join(children(below).withColumnRenamed("node", "conv_id"), "conv_id", "left")
        alone = F.when((F.col("n_convs") == 1) & (F.col("length") > d), 1).otherwise(0)
        below = scratch.write(
            nodes.select("conv_id", "node", "n_convs", F.coalesce("children", alone).cast("bigint").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
                         (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "length"), f"totals/depth={d}")


def children(below: DataFrame) -> DataFrame:
    return below.groupBy("node").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def ends(members: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes in which conversations (conv_id, depth, member) end."""
    key = ["conv_id", "depth"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, out = None, [], []
        for batch in batches:
            for conv, depth, member in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "member")), strict=True):
                if at != (conv, depth) or len(ids) == CHUNK:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = (conv, depth), []
                ids.append(member)
            if len(out) >= 1_000:
                yield as_batch(out, RUNS)
                out = []
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))
        yield as_batch(out, RUNS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for batch in batches:
            for conv, depth, run in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if at != (conv, depth):
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (conv, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(run.encode())
            if len(out) >= 1_000:
                yield as_batch(out, HASHES)
                out = []
        if at is not None:
            out.append((*at, digest.hexdigest()))
        yield as_batch(out, HASHES)

    ordered = members.repartitionByRange(*key, "member").sortWithinPartitions(*key, "member")
    joined = ordered.mapInArrow(runs, "conv_id bigint, depth bigint, first bigint, ids string")
    return joined.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "conv_id bigint, depth bigint, ends_sha256 string")


RUNS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
HASHES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _between(low: Column, high: Column) -> tuple[Column, Column]:
    """Starts of runs of 4,096 numbers from low to high, and the numbers of the run that begins at ``start``."""
    return F.explode(F.sequence(low, high, F.lit(4096).cast("bigint"))).alias("start"), F.explode(F.sequence(F.col("start"), F.least(F.col("start") + 4095, high))).alias("depth")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession)
    turns, convs = rebuild(*numbered_turns(conversations.select("conv_id", "turn", "role", "text"), scratch), scratch)
    root, total = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    depth = levels(turns, root, scratch)
    roll_up(spark, depth, scratch)
    top = spark.range(1).select(F.lit(root).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(total).cast("bigint").alias("n_convs"))
    members = convs.filter("length = 0").select(F.lit(root).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.col("conv_id").alias("member"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not depth:
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        found = top.select("*", none.alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"))
    else:
        totals = spark.read.parquet(f"{scratch.root}/totals").withColumn("depth", F.col("depth").cast("bigint"))
        first = children(totals.filter("depth = 1")).select(F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        low, high = F.col("from") + 1, F.col("length")
        alone = totals.filter("n_convs = 1 and length > depth").select("conv_id", F.col("depth").alias("from"), "length")
        starts, depths = _between(low, high)
        chain = alone.select("conv_id", "length", "from", starts).select("conv_id", "length", depths)
        below = (F.col("depth") < F.col("length")).cast("bigint")
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        chain = chain.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), below.alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"))
        found = top.crossJoin(F.broadcast(first)).unionByName(totals.withColumnRenamed("node", "parent_conv_id").select(names)).unionByName(chain)
        steps = spark.read.parquet(f"{scratch.root}/steps").filter("length = depth").select(F.col("conv_id").alias("member"), "depth", "node", "digest")
        nodes = spark.read.parquet(f"{scratch.root}/nodes").filter("n_convs > 1").select("depth", "node", "digest", "conv_id", "n_convs")
        ended = join_facts(steps, nodes, ["depth", "node", "digest"], "n_convs", total)
        members = members.unionByName(ended.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "member"))
    found = found.join(ends(members), ["conv_id", "depth"], "left")
    own = F.when((F.col("n_convs") == 1) & (F.col("n_children") == 0) & (F.col("depth") > 0), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    return found.select(*names, F.coalesce("ends_sha256", own, F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: crc32 is spelt out bit by bit; a node is a distinct chain of turn hashes.
ORACLE_SQL = r"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(conv_id::VARCHAR))), lambda a, i:
      CASE WHEN xor(a, CASE WHEN i % 8 = 0 THEN ascii(substring(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT) % 2 = 1
        THEN xor((xor(a, CASE WHEN i % 8 = 0 THEN ascii(substring(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT) >> 1), 3988292384::BIGINT)
        ELSE xor(a, CASE WHEN i % 8 = 0 THEN ascii(substring(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT) >> 1 END), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)
), r AS (
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)) AS pos, o.role, o.text FROM o JOIN c USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE o.pos >= c.h
  UNION ALL SELECT c.conv_id, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
), p AS (
  SELECT conv_id, pos + 1 AS depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY conv_id) AS length FROM r
  UNION ALL SELECT c.conv_id, 0, '', 0, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c
), q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent_key FROM p),
n AS (
  SELECT depth, key, any_value(parent_key) AS parent_key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM q GROUP BY depth, key
), k AS (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
s AS (
  SELECT p.depth, p.key, sum((a.n_convs - 1) * a.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM n a LEFT JOIN k ON k.depth = a.depth AND k.key = a.key JOIN p ON p.conv_id = a.conv_id AND p.depth <= a.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.parent_key LEFT JOIN k ON k.depth = n.depth AND k.key = n.key JOIN s ON s.depth = n.depth AND s.key = n.key
"""
