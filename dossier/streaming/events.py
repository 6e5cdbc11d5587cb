"""Structured Streaming over event files: reconciliation, rate limiting and queue state.

Batches go through ``foreachBatch`` into versioned tables or through stateful aggregates; every stream runs
with ``availableNow`` here and continuously elsewhere.  The checkpoint folder is the caller's, or one under
spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one in the warehouse folder if Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/dossier-streams"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The events as a stream; the file's time without zone becomes a timestamp, so that it can have a watermark."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        # a stream watches a folder: of the file's own folder it takes just that file
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run(frame: DataFrame, spark: SparkSession, mode: str, name: str, state: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote; ``state`` names a folder to go on from.

    A batch of an update is a folder of its own, written over if the batch is repeated.
    """
    out = state or folder(spark, name)
    if mode == "append":
        query = frame.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{out}/data")

    def save(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/version={k}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in frame.schema)}, version int").parquet(f"{out}/data")


def hourly_codes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Codes asked for per user and hour, with a watermark for late events."""
    asked = events.filter("event_type = 'signup'").withWatermark("ts", late)
    return asked.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("hour"), "n")


def reconcile_stream(events: DataFrame, moves: dict[str, tuple[tuple[str, ...], str]], start: str = "open", late: str = "10 minutes") -> DataFrame:
    """Status per user after its events in event time, as far as the watermark has come."""
    from dossier.streaming.ordered import in_event_order

    def step(state: dict, event: dict) -> dict:
        status = state.get("status", start)
        sources, target = moves.get(event.get("event_type"), ((), status))
        return {"status": target if status in sources else status, "n_actions": state.get("n_actions", 0) + 1}

    return in_event_order(events, "user_id", "event_id", step, lambda state: [state], "user_id bigint, status string, n_actions bigint", late)


def latest(versions: DataFrame, *key: str) -> DataFrame:
    """Of each key the row written last."""
    return versions.groupBy(*key).agg(F.max_by(F.struct(*(c for c in versions.columns if c not in (*key, "version"))), "version").alias("r")).select(*key, "r.*")
