"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Setting by which Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a null doc_id, which so counts as the largest.
NO_ID = 2**63 - 1
#: Upper bound on the rows of a side that may be broadcast.
BROADCAST_ROWS = 50_000
#: join_facts: a hot key has over HOT_ROWS rows; there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one in the warehouse folder if Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/llm-scratch"
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage so that a lost executor costs no recomputation.

    A result may read them as long as the driver's Python runs; they are deleted when it ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes the frame as parquet (a folder for each value of ``by``) and returns it reread.

        Spark deletes the shuffle files of the write as soon as it ends: what follows reads the table.
        """
        path = f"{self.root}/{name}"
        conf, schema = self.spark.conf, frame.schema
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            (frame.write.partitionBy(by) if by else frame.write).parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables (or folders of a partition) that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.drop("")


def join_checked(left: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Joins with a broadcast only if ``rows``, the counted rows of ``small``, stays under BROADCAST_ROWS."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Joins what is known of each key to the rows of that key; no key's rows have to meet in one task.

    ``facts`` has one row per key (never null) with the number of its rows in ``size``; ``total`` is the number of all rows.
    Keys above HOT_ROWS rows and a 10,000th of the total are at most HOT_KEYS by count, so they are broadcast.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = facts.filter(F.col(size) > limit), facts.filter(F.col(size) <= limit)
    names = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(names, on, "left_anti").join(rest, on))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    )


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, twin, text, row: twin tells rows with one doc_id apart; it is 0 everywhere if ids are unique.

    row holds all columns but the text, so that their names cannot clash with ours.
    """
    row = F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row")
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", F.lit(True).alias("shared"))
    if not (rows := shared.count()):
        return docs.select("doc_id", F.lit(0).alias("twin"), "text", "row")
    marked = join_checked(docs, shared, ["doc_id"], rows, "left")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    return (
        marked.filter("shared is null").select("doc_id", F.lit(0).alias("twin"), "text", "row")
        .unionAll(marked.filter("shared").select("doc_id", order.alias("twin"), "text", "row"))
    )


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n+1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string()).fill_null(b"" if binary else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of ``edges`` (a, b): columns node, component.

    Alternates large-star and small-star over written tables.  Neighbourhoods are reduced to their
    minimum by a partial aggregate, never gathered, so that a node with very many links is no hot group.
    Self-links and repeated links are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    current = scratch.write(edges.filter("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), "cc-0")
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, name = digest(current), "cc-0"
    for k in range(1, max_rounds):
        # large star: larger neighbours of each node link to the smallest of the neighbourhood and the node
        pairs = both(current)
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            low.select("a", F.col("m").alias("b"))
        )
        now = scratch.write(small.filter("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), f"cc-{k}")
        scratch.drop(name)
        name, current, after = f"cc-{k}", now, digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    found = nodes.unionAll(roots.join(nodes.select("node"), "node", "left_anti"))
    return spark.createDataFrame([], "node bigint, component bigint") if before[0] == 0 else found


def named_by_least(points: DataFrame, components: DataFrame) -> DataFrame:
    """node and component_id: the least ``low`` of any point (node, low) in the node's component."""
    placed = points.select("node", "low").join(components, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    return placed.join(least, "component").select("node", "component_id")
