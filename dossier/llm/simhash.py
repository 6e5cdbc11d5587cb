"""Operator 7: SimHash near-dedup with vantage-point trees.

Fingerprints of word shingles link at ``radius`` or fewer differing bits.  Equal fingerprints are one
point.  A vantage-point tree over a bounded sample of points (at most SAMPLE) cuts the space into shards:
a point descends to the near side of a node if its Hamming distance to the vantage point is at most the
node's, else to the far side; where the triangle bound leaves both sides open it also queries the other
one.  So each pair within the radius meets in a shard, exactly.  A shard searches with a tree of its own
and returns at most one link per point (a spanning forest of its links).  A shard over SHARD points is
dealt out as pairs of blocks.  Components come from alternating stars over those links.

Defined results: lower-casing touches A-Z only; fewer words than a shingle give one shingle of them all;
no words (null, empty, blank) give the zero fingerprint, which links like any other; a null doc_id counts
as the largest id; rows that share a doc_id are documents of their own; a text is read whole, its hashes in
parts; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import near_copies
from dossier.llm.common import NO_ID, Scratch, connected_components, join_checked, named_by_least, read

SHINGLE = 3
RADIUS = 2
#: Points that the shared tree is fitted on, points aimed at in a shard, points over which a shard is split.
SAMPLE = 16_384
AIM = 8_192
SHARD = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a signed integer: a bit is set if over half the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = [xxhash.xxh64_digest(joined, 42)]
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashed = xxhash.xxh64_digest
        digests = [hashed(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:], strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 15):
        ones += bit_counts(b"".join(digests[at : at + (1 << 15)]))
    return majority(ones, len(digests))


def bit_counts(digests: bytes) -> np.ndarray:
    """How many of the digests, of 8 bytes each, have each bit."""
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint, as a signed integer, of n digests with these counts of bits."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint_of(elements: np.ndarray) -> int:
    """The fingerprint of hashed shingles (near_copies.shingles)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(elements), 1 << 15):
        ones += bit_counts(elements[at : at + (1 << 15)].astype(">u8").tobytes())
    return majority(ones, len(elements))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(task, "doc_id bigint, fp bigint")


def grown(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a tree in heap order; a radius of 64 sends everything to the near side."""
    points, radii = np.zeros(2**depth, np.uint64), np.full(2**depth, 64, np.int64)
    subsets = {1: sample}
    for node in range(1, 2**depth):
        own = subsets.pop(node, sample[:0])
        if len(own) < 2:
            continue
        # of a few candidates the one whose distances spread most
        tried = own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]
        spread = [np.bitwise_count(own ^ c).astype(np.int64) for c in tried]
        best = max(range(len(tried)), key=lambda k: (spread[k].std(), -k))
        points[node], radii[node] = tried[best], int(np.median(spread[best]))
        near = spread[best] <= radii[node]
        subsets[2 * node], subsets[2 * node + 1] = own[near], own[~near]
    return points, radii


def routed(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, radius: int):
    """Home shard of each point, and (point, shard) of the later shards that its ball reaches."""
    points, radii = tree
    home = np.ones(len(fps), np.int64)
    who, node = np.arange(len(fps)), np.ones(len(fps), np.int64)
    for _ in range(depth):
        home = 2 * home + (np.bitwise_count(fps ^ points[home]).astype(np.int64) > radii[home])
        distance = np.bitwise_count(fps[who] ^ points[node]).astype(np.int64)
        near, far = distance - radius <= radii[node], distance + radius > radii[node]
        who, node = np.r_[who[near], who[far]], np.r_[2 * node[near], 2 * node[far] + 1]
    later = node > home[who]
    return home, who[later], node[later]


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each points to its root) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def linked(fps: np.ndarray, stored: np.ndarray, asking: np.ndarray, radius: int) -> np.ndarray:
    """Component labels of all points given the links between stored points and asking ones."""
    label = np.arange(len(fps))
    rng = np.random.default_rng(1)
    work = [(stored, asking)]
    while work:
        p, q = work.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > 64 and len(p) * len(q) > 1 << 18:
            v = fps[p[rng.integers(len(p))]]
            dp, dq = np.bitwise_count(fps[p] ^ v).astype(np.int64), np.bitwise_count(fps[q] ^ v).astype(np.int64)
            middle = int(np.median(dp))
            if (far := dp > middle).any() and not far.all():
                work += [(p[~far], q[dq - radius <= middle]), (p[far], q[dq + radius > middle])]
                continue
        for i in range(0, len(p), 1024):
            for j in range(0, len(q), 1024):
                pi, qj = p[i : i + 1024], q[j : j + 1024]
                x, y = np.nonzero(np.bitwise_count(fps[pi][:, None] ^ fps[qj][None, :]) <= radius)
                label = hook(label, pi[x], qj[y])
    return label


def links(points: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between nodes of points (fp, node) that connect all pairs within the radius."""
    spark = points.sparkSession
    n = points.count()
    depth = 0
    while AIM << depth < n and depth < 12:
        depth += 1
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect() if depth else []
    tree = spark.sparkContext.broadcast(grown(np.array([r.fp for r in sample], np.int64).view(np.uint64), depth))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes = b.column("fp").to_numpy(), b.column("node").to_numpy()
            home, who, shard = routed(fps.view(np.uint64), tree.value, depth, radius)
            for s, f, k, asks in ((home, fps, nodes, False), (shard, fps[who], nodes[who], True)):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(f), pa.array(k), pa.array(np.full(len(s), asks))], ["shard", "fp", "node", "asks"])

    rows = scratch.write(points.mapInArrow(route, "shard bigint, fp bigint, node bigint, asks boolean"), "routed")
    # shards are at most 4096; large ones become pairs of blocks
    sizes = rows.groupBy("shard").agg(F.count("*").alias("size")).select("shard", F.ceil(F.col("size") / SHARD).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "shard").withColumn("block", F.expr("pmod(xxhash64(fp), blocks)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "node", "asks")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        fps, node, stored = group["fp"].to_numpy().view(np.uint64), group["node"].to_numpy(), np.flatnonzero(~group["asks"].to_numpy())
        label = linked(fps, stored, np.arange(len(fps)), radius)
        more = label != np.arange(len(fps))
        return pd.DataFrame({"a": node[more], "b": node[label[more]]})

    return rows.groupBy("shard", "i", "j").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(fingerprints(docs, shingle), "fingerprints")
    points = scratch.write(marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("low")), "points")
    found = connected_components(links(points.select("fp", F.col("fp").alias("node")), radius, scratch), scratch)
    classes = scratch.write(named_by_least(points.withColumnRenamed("fp", "node"), found).withColumnRenamed("node", "fp"), "classes")
    rows = classes.count()
    named = join_checked(marked, classes, ["fp"], rows)
    return named.select("doc_id", "fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint in hex and the smallest doc_id reachable."""
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_classes(marks: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """node, key of every node (near_copies.marked) with words: nodes of one key have fingerprints linked at ``radius`` or fewer bits."""
    nodes = scratch.write(marks.filter("size(keys) > 0").select("node", "fp").distinct(), "nodes")
    points = scratch.write(nodes.select("fp").distinct(), "points")
    found = links(points.select("fp", F.col("fp").alias("node")), radius, scratch)
    found = scratch.write(connected_components(found, scratch).withColumnRenamed("node", "fp"), "linked")
    return join_checked(nodes, found, ["fp"], found.count(), "left").select("node", F.coalesce("component", "fp").alias("key"))


def keep_first(docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays.

    Near copies are pairs whose shingles reach the similarity.  Documents whose fingerprints are linked within the radius,
    by the trees of operator 7, are compared first; those links alone would lose nearly all copies with more than a
    handful of edited words, so near_copies goes on to the pairs beyond the radius.
    Rows are told apart by doc_id and text: of a component's rows with its smallest doc_id the least by
    text, then by all columns as JSON, stays. Other documents of the same id, or without one, stay too.
    Columns of any name and type pass through in a struct.
    """
    scratch = Scratch(docs.sparkSession)
    marks = scratch.write(near_copies.marked(docs, shingle, fingerprint_of), "marks")
    found = near_copies.components(docs, marks, fingerprint_classes(marks, radius, Scratch(docs.sparkSession)), scratch, shingle, similarity)
    low = found.groupBy("component").agg(F.min("id").alias("id"))
    firsts = scratch.write(found.join(low, ["component", "id"]).groupBy("component", "id", "h", "g").agg(F.count("*").alias("rows")), "firsts")
    tied = scratch.write(firsts.groupBy("component").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("component"), "tied")
    rows, ties = firsts.count(), tied.count()
    chosen = join_checked(near_copies.identified(docs), firsts.drop("rows"), ["id", "h", "g"], rows)
    if not ties:
        return chosen.select("row.*")
    # a minimum is taken in each task first, so that a large group of ties is no hot group
    single = join_checked(chosen, tied, ["component"], ties, "left_anti").select("row")
    least = join_checked(chosen, tied, ["component"], ties, "left_semi").groupBy("component").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return single.unionAll(least.select("row")).select("row.*")
