r"""Operator 11: exact deduplication by stateful streaming.  DataFrame functions only.

Two streams, both restarted from their checkpoints when more files have come:

1. every row of the table is normalised and logged: doc_id, content locator (file and row in it), digest, SHA-256;
2. the log is aggregated by digest in RocksDB state, kept on disk and without expiry: the state of a digest is its
   least row (doc_id, then locator) and how many rows have it.  What a batch changes is written as a version.

A digest is 16 bytes, so equal digests prove nothing: of each digest with several rows the locators fetch the whole
texts, which are compared with that of the row which stays.  Rows that differ from it are grouped by their texts.

A digest's rows need not meet in one task: counts and least rows are pre-aggregated, the state of the most frequent
digests (at most 10,000 by count) is broadcast, and in the comparison the text that stays is copied to one salt for
SALT_ROWS rows of its group.

Defined results: null texts are empty; a null doc_id counts as the largest, and stays null in the result; of rows with
one doc_id and equal texts the first by locator stays; very long texts are compared whole; other columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import BROADCAST_ROWS, Scratch, join_facts

SALT_ROWS = 2_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a store reserves 4 MB of disk before it holds anything unless told not to
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
LOG = "doc_id bigint, file string, place bigint, digest binary, text_sha256 string"
GROUPS = "digest binary, first struct<unnamed:boolean,doc_id:bigint,file:string,place:bigint>, rows bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def short_digest(text_sha256: Column) -> Column:
    return F.unhex(F.substring(text_sha256, 1, 32))


def located(frame: DataFrame) -> DataFrame:
    """doc_id, text and content locator of a table read from files."""
    return frame.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")
    )


def _stream(spark: SparkSession, path: str, files: int | None) -> DataFrame:
    """A Parquet file or folder as a stream (a stream watches a folder: of a file's folder it takes just that file)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path)


def absorb(spark: SparkSession, path: str, folder: str, files: int | None = None, digest: Callable[[Column], Column] = short_digest) -> None:
    """Brings log and state in ``folder`` up to date with what the table at ``path`` holds now.

    ``files`` bounds the files of a batch.  After a failure the next call goes on from the checkpoint; a repeated
    batch overwrites its own version.
    """
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{folder}/log")
    spark.createDataFrame([], GROUPS).write.mode("ignore").parquet(f"{folder}/groups/version=-1")
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    rows = located(_stream(spark, path, files)).select("doc_id", "file", "place", sha.alias("text_sha256"))
    rows = rows.select("doc_id", "file", "place", digest(F.col("text_sha256")).alias("digest"), "text_sha256")

    def log(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={k}")

    def save(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/groups/version={k}")

    rows.writeStream.option("checkpointLocation", f"{folder}/log-checkpoint").foreachBatch(log).trigger(availableNow=True).start().awaitTermination()
    logged = spark.readStream.schema(LOG).option("recursiveFileLookup", "true")
    logged = (logged.option("maxFilesPerTrigger", files) if files else logged).parquet(f"{folder}/log")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "place")
    groups = logged.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("rows"))
    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        groups.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """digest, first, rows as of the last version of each."""
    versions = spark.read.schema(f"{GROUPS}, version int").parquet(f"{folder}/groups")
    return versions.groupBy("digest").agg(F.max_by(F.struct("first", "rows"), "version").alias("s")).select("digest", "s.*")


def differing(spark: SparkSession, path: str, placed: DataFrame) -> DataFrame:
    """digest, text, doc_id, file, place of the rows whose whole texts differ from that of their digest's first row."""
    hits = placed.filter("rows > 1").select(
        "file", "place", "digest", ((F.col("file") == F.col("first.file")) & (F.col("place") == F.col("first.place"))).alias("stays"),
        F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts"),
    )
    few = hits.count() <= BROADCAST_ROWS
    texts = located(spark.read.parquet(path)).join(F.broadcast(hits) if few else hits, ["file", "place"])
    texts = texts.select("digest", "doc_id", "file", "place", "stays", "salts", normalised(F.col("text")).alias("text"))
    kept = texts.filter("stays").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("kept_text"))
    others = texts.filter("not stays").withColumn("salt", F.pmod(F.xxhash64("file", "place"), F.col("salts")).cast("int"))
    return others.join(kept, ["digest", "salt"]).filter("text <> kept_text").select("digest", "text", "doc_id", "file", "place")


def verdicts(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, place of every row that ``absorb`` has seen."""
    scratch = Scratch(spark)
    rows = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{folder}/log")
    state = scratch.write(state_of(spark, folder), "state")
    total = state.agg(F.sum("rows")).first()[0] or 0
    placed = scratch.write(join_facts(rows, state, ["digest"], "rows", total), "placed")
    strays = scratch.write(differing(spark, path, placed), "strays")
    if (count := strays.count()) > 0:
        placed = _parted(placed, strays, count)
    stays = (F.col("file") == F.col("first.file")) & (F.col("place") == F.col("first.place"))
    return placed.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("rows").alias("group_size"), stays.alias("kept"), "text_sha256", "file", "place")


def _parted(placed: DataFrame, strays: DataFrame, count: int) -> DataFrame:
    """Rows that share a digest but not the text get groups of their own; their number leaves the digest's group."""
    few = count <= BROADCAST_ROWS
    told = (lambda f: F.broadcast(f)) if few else (lambda f: f)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "place")
    groups = strays.groupBy("digest", "text").agg(F.min(first).alias("own_first"), F.count("*").alias("own_rows"))
    own = strays.join(groups, ["digest", "text"]).select("file", "place", "own_first", "own_rows")
    gone = strays.groupBy("digest").agg(F.count("*").alias("gone"))
    joined = placed.join(told(own), ["file", "place"], "left").join(told(gone), "digest", "left")
    return joined.select(
        "doc_id", "file", "place", "text_sha256", F.coalesce("own_first", "first").alias("first"),
        F.coalesce("own_rows", F.col("rows") - F.coalesce("gone", F.lit(0))).alias("rows"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its text that stays."""
    path, folder = f"{sf_dir}/documents.parquet", Scratch(spark).root
    absorb(spark, path, folder)
    return verdicts(spark, path, folder).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
