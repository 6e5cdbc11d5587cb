"""Tables that several writers extend at once: data first, then one commit file that only one of them can create.

A folder holds ``data/<batch>/`` (Parquet, invisible until committed) and ``commits/<version>`` (the name of the batch).
A writer reads the last version, writes what differs from it, and creates the next commit; if another writer has created
it first, it looks again at what differs from the new version.  A reader takes the batches of the commits it lists, so it
sees all of a version or nothing of it.  Data without a commit (of a writer that died) is never read.

Commits are files of a few bytes, listed on the driver: one for each publication, not for each row.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from dossier.sources.files import problems

ATTEMPTS = 2


class Conflict(RuntimeError):
    """Other writers were first in every attempt."""


class Refused(ValueError):
    """A batch of uploads with the reasons why none of it was stored."""

    def __init__(self, reasons: list[tuple[str, str]]):
        super().__init__(f"{len(reasons)} problems; nothing was stored")
        self.reasons = reasons


class Published:
    """Rows by key in versions: a key's row is the one published last; a null payload takes the key away."""

    def __init__(self, spark: SparkSession, path: str, key: str, payload: str):
        self.spark, self.path, self.key, self.payload = spark, path.rstrip("/"), key, payload
        self.keep = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.keep.getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commits(self) -> list[tuple[int, str]]:
        """Versions with their batches, in order."""
        folder = self._place("commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted((int(v), batch) for v, _, batch in (self._read(n).partition(" ") for n in names if n.isdigit()))

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._place(f"commits/{name}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def commit(self, version: int, batch: str) -> bool:
        """Creates the commit of a version with its content in one step; False if it exists."""
        draft, target = self._place(f"commits/_{batch}"), self._place(f"commits/{version:012d}")
        stream = self.fs.create(draft, True)
        stream.writeUTF(f"{version} {batch}")
        stream.close()
        jvm = self.spark._jvm
        try:
            if self.fs.getScheme() == "file":  # a local rename would replace: a hard link fails if the name is taken
                local = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI.create(self.fs.makeQualified(p).toUri().toString().replace("file:/", "file:///", 1)))
                jvm.java.nio.file.Files.createLink(local(target), local(draft))
                self.fs.delete(draft, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.keep.toUri()).rename(draft, target, none)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def versions(self, upto: int | None = None) -> DataFrame:
        """Every published row with its version, up to one of them."""
        known = [(v, b) for v, b in self.commits() if upto is None or v <= upto]
        if not known:
            return self.spark.createDataFrame([], f"`{self.key}` string, `{self.payload}` string, content_hash string, batch string, version bigint")
        rows = self.spark.read.parquet(*(f"{self.path}/data/{b}" for _, b in known))
        return rows.join(F.broadcast(self.spark.createDataFrame([(b, v) for v, b in known], "batch string, version bigint")), "batch")

    def current(self, upto: int | None = None, show: list[Column] | None = None, key_as: DataType | None = None) -> DataFrame:
        """Of each key the row published last: key, payload, content_hash, version; keys that were taken away are left out.

        ``show``: columns instead of payload and content_hash, made before rows are dealt out by key; ``key_as``: type of the key.
        """
        rows = self.versions(upto)
        if key_as is not None:
            rows = rows.withColumn(self.key, F.col(self.key).cast(key_as))
        shown = [F.col(self.payload), F.col("content_hash")] if show is None else show
        last = F.max_by(F.struct(*shown, "version", F.col(self.payload).isNotNull().alias("held")), "version").alias("r")
        return rows.groupBy(self.key).agg(last).select(self.key, "r.*").filter("held").drop("held")

    def publish(self, now: DataFrame, attempts: int = ATTEMPTS, before_commit=None, differs_from: int | None = None) -> int | None:
        """Publishes the rows (key, payload) that differ from the last version; the version, or None if nothing differs.

        ``differs_from``: a version from which all rows are known to differ; while it is the last, they are not compared.
        ``before_commit`` is called between writing and committing (for tests of writers that meet).
        """
        hashed = now.select(F.col(self.key).cast("string").alias(self.key), F.col(self.payload), F.sha2(F.coalesce(self.payload, F.lit("")).cast("binary"), 256).alias("content_hash"))
        for _ in range(attempts):
            base = max((v for v, _ in self.commits()), default=0)
            changed = hashed
            if base != differs_from:
                old = self.current(base, [F.col("content_hash").alias("old_hash")]).drop("version")
                changed = hashed.join(old, self.key, "left").filter("old_hash is null or old_hash <> content_hash").filter(F.col(self.payload).isNotNull() | F.col("old_hash").isNotNull()).drop("old_hash")
            batch = uuid.uuid4().hex
            folder = f"data/{batch}"
            changed.withColumn("batch", F.lit(batch)).write.parquet(f"{self.path}/{folder}")
            if self.spark.read.parquet(f"{self.path}/{folder}").isEmpty():
                self.fs.delete(self._place(folder), True)
                return None
            if before_commit is not None:
                before_commit()
            if self.commit(base + 1, batch):
                return base + 1
            self.fs.delete(self._place(folder), True)
        raise Conflict(f"version taken by others in {attempts} attempts")


def ingest(store: Published, files: DataFrame, most_files: int, most_bytes: int) -> int | None:
    """Takes all of a batch of uploads (see ``files.uploads``) in one version, or raises Refused and stores nothing.

    A document's payload holds its metadata and its audit event, which so appear together.
    """
    if reasons := [(r["name"], r["problem"]) for r in problems(files, most_files, most_bytes).limit(1_000).collect()]:
        raise Refused(reasons)
    event = F.struct(F.lit("document_uploaded").alias("type"), F.concat(F.lit("Uploaded "), "name").alias("message"))
    payload = F.to_json(F.struct("name", "size", "sha256", "kind", event.alias("event")))
    return store.publish(files.select(F.col("path").alias(store.key), payload.alias(store.payload)))
