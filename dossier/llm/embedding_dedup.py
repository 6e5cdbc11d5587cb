"""Operator 6: embedding near-dedup with a pivot-permutation index.

A vector is described by its nearest pivots in order (cosine; pivots are a bounded sample of the vectors,
about PIVOTS_PER_ROOT times the root of their number).  Inverted lists hold, for each label and pivot, the
vectors that have it among their first LISTED.  Inside a list the pivots beyond its own are counted first:
two vectors are compared only if they share a second pivot (SHARED), and every pair that is compared and
verified by cosine in double precision is a link, taken once, in the list and sub-list of the least two
pivots that both have.  Every vector is indexed; only pairs without shared pivots can be
missed (recall is measured in tests/llm).

Equal vectors of a label are one point with a weight, so groups of copies cost nothing.  A list is dealt
out in pairs of blocks of BLOCK points, so no task holds a list whole; a block pair returns a link count
per point and a spanning forest of its links, never the pairs.  Components come from alternating stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with
a null label, link with nothing and are their own component; vectors of different lengths never link;
rows sharing a vec_id are vectors of their own; a null vec_id counts as the largest, is its component's
null and is not kept; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import NO_ID, Scratch, connected_components, named_by_least, read
from dossier.llm.simhash import hook

THRESHOLD = 0.98
PIVOTS_PER_ROOT = 2
MOST_PIVOTS = 16_384
LISTED = 8
SHARED = 2
BLOCK = 2_000
#: Groups that the lists' block pairs are dealt to, at least, and listed rows to a group.
GROUPS = 512
GROUP_ROWS = 50_000


def points_of(vectors: DataFrame) -> DataFrame:
    """One row per label and vector that can link: point (a number), label, v (as doubles), copies, low (smallest vec_id)."""
    valid = vectors.filter("label is not null and embedding is not null and size(embedding) > 0").filter(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    # -0.0 is 0.0
    double = valid.select(F.coalesce("vec_id", F.lit(NO_ID)).cast("bigint").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    points = double.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # numbered inside hash buckets, so no task sees them all
    bucket = points.withColumn("bucket", F.expr("pmod(xxhash64(label, v), 4096)"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("label", "v"))
    return bucket.withColumn("point", F.col("bucket") * 2**40 + place).drop("bucket")


def units(rows: list | np.ndarray) -> np.ndarray:
    """Scaled to length 1, by the largest component first, so that squares neither overflow nor vanish."""
    x = np.array(rows, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def described(points: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], listed: int) -> DataFrame:
    """Adds ``nearest``, the nearest pivots of a vector's own length in order."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                size = np.asarray(some.column("v").value_lengths())
                nearest: list = [None] * some.num_rows
                for d in np.unique(size):
                    own = np.flatnonzero(size == d)
                    begin, p = shared.value.get(int(d), (0, None))
                    if p is None:  # no vector of this length in the sample: one list for them all
                        found = np.full((len(own), 1), -int(d))
                    else:
                        near = units(some.column("v").take(pa.array(own)).to_pylist()) @ p.T
                        k = min(listed, near.shape[1])
                        found = np.argpartition(-near, k - 1, axis=1)[:, :k]
                        found = begin + np.take_along_axis(found, np.argsort(-np.take_along_axis(near, found, 1), axis=1, kind="stable"), 1)
                    for row, f in zip(own, found, strict=True):
                        nearest[row] = f.tolist()
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(nearest, pa.list_(pa.int32()))], [*some.schema.names, "nearest"])

    return points.select("point", "label", "v", "copies").mapInArrow(task, "point bigint, label bigint, v array<double>, copies bigint, nearest array<int>")


def members(nearest: np.ndarray, pivot: int) -> dict[int, np.ndarray]:
    """The rows that list each pivot beyond this one."""
    row, place = np.nonzero(nearest > pivot)
    own = nearest[row, place]
    order = np.argsort(own, kind="stable")
    own, row = own[order], row[order]
    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    return dict(zip(own[cut].tolist(), np.split(row, cut[1:]), strict=False)) if len(own) else {}


def compare(threshold: float, shared: int):
    """Work on one pair of blocks of one list.

    Pivots are counted before anything is compared: pairs that share a second pivot are those that meet in
    a sub-list of one.  A pair is taken where the list and the sub-list are of its least common pivots.
    """

    def run(key: tuple, x: dict, y: dict | None) -> pd.DataFrame:
        _, pivot, _, _ = key
        left, right = x, y or x
        points = np.r_[left["point"], right["point"]] if y else left["point"]
        base = len(left["point"]) if y else 0
        links, label = np.zeros(len(points), np.int64), np.arange(len(points))
        if pivot < 0 or min(shared, left["nearest"].shape[1]) < 2:
            everyone = np.arange(len(left["point"])), np.arange(len(right["point"]))
            work = [(None, *everyone)]
        else:
            own = members(left["nearest"], pivot)
            others = members(right["nearest"], pivot) if y else own
            work = [(q, own[q], others[q]) for q in own.keys() & others.keys()]
        for second, p, q in work:
            for at in range(0, len(p), 512):
                i, j = np.nonzero(left["unit"][p[at : at + 512]] @ right["unit"][q].T >= threshold)
                i, j = p[at : at + 512][i], q[j]
                if not y:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                a, b = left["nearest"][i], right["nearest"][j]
                common = np.sort(np.where(((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(2), a, np.iinfo(np.int32).max), 1)
                mine = (pivot < 0) | (common[:, 0] == pivot)
                if second is not None:
                    mine &= common[:, 1] == second
                i, j = i[mine], j[mine] + base
                np.add.at(links, i, right["copies"][j - base])
                np.add.at(links, j, left["copies"][i])
                label = hook(label, i, j)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(points))))
        return pd.DataFrame({"point": points[some], "links": links[some], "root": points[label[some]]})

    return run


def linked(index: DataFrame, threshold: float, shared: int, scratch: Scratch, groups: int = 512) -> DataFrame:
    """point, links (weighted), root of every block pair."""
    rows = index.withColumn("pivot", F.explode("nearest"))
    sizes = rows.groupBy("label", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["label", "pivot"]).withColumn("block", F.expr("cast(pmod(xxhash64(point), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("label", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "point", "copies", "v", "nearest")
    # many small lists to a group; large ones spread, as their block pairs are groups' keys
    rows = rows.withColumn("bin", F.expr(f"pmod(xxhash64(label, pivot, i, j), {groups})"))
    work = compare(threshold, shared)

    def task(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def side(frame: pd.DataFrame) -> dict:
            return {"point": frame["point"].to_numpy(), "copies": frame["copies"].to_numpy(), "unit": units(frame["v"].tolist()), "nearest": np.array(frame["nearest"].tolist(), np.int32)}

        def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            if key[2] == key[3]:
                return work(key, side(frame), None)
            return work(key, side(frame[frame["block"] == key[2]]), side(frame[frame["block"] == key[3]])) if frame["block"].nunique() == 2 else empty

        empty = pd.DataFrame({"point": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        names, held, last = ["label", "pivot", "i", "j"], [], None
        for frame in group:  # rows come sorted by the key: a key is worked on when the next one begins
            for key, part in frame.groupby(names, sort=False):
                if last is not None and key != last:
                    yield of(last, pd.concat(held))
                    held = []
                last = key
                held.append(part)
        if held:
            yield of(last, pd.concat(held))

    ordered = rows.repartition(F.col("bin")).sortWithinPartitions("label", "pivot", "i", "j", "block", "point")
    return scratch.write(ordered.drop("bin").mapInPandas(task, "point bigint, links bigint, root bigint"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, listed: int = LISTED, shared: int = SHARED, pivots_per_root: float = PIVOTS_PER_ROOT) -> DataFrame:
    """vec_id, n_links, component_id of every row."""
    scratch = Scratch(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("bigint").alias("label"))
    points = scratch.write(points_of(vectors), "points")
    n = points.count()
    most = min(MOST_PIVOTS, max(16, int(pivots_per_root * n**0.5)))
    sample = points.orderBy(F.xxhash64("point", "label"), "point", "label").limit(most).select("v").toArrow().column("v").combine_chunks()
    size = np.asarray(sample.value_lengths())
    pivots, begin = {}, 0  # numbered on over all lengths, so that a list holds one length
    for d in np.unique(size):
        v = np.asarray(sample.filter(pa.array(size == d)).flatten()).reshape(-1, d)
        pivots[int(d)], begin = (begin, units(v)), begin + len(v)
    index = scratch.write(described(points, pivots, listed), "index")
    found = linked(index, threshold, shared, scratch, max(GROUPS, n * listed // GROUP_ROWS))
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("point").alias("a"), F.col("root").alias("b")), scratch)
    names = named_by_least(points.select(F.col("point").alias("node"), "low"), components).withColumnRenamed("node", "point")
    named = points.join(counts, "point", "left").join(names, "point")
    named = scratch.write(named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    rows = vectors.withColumn("v", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    rows = rows.join(named, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(component < NO_ID, component).alias("component_id"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: links, component and whether it stays."""
    found = near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: The query by comparing all pairs.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
