"""File sources: fixtures, manifests with an integrity check, binary uploads with a content sniff."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURE = "document string, document_sha256 string, engine string, pages array<struct<page:int,lines:array<struct<text:string,bbox:array<double>,confidence:double>>>>"
MANIFEST = "files array<struct<filename:string,path:string,label:string,media_type:string,pages:int,size_bytes:bigint,sha256:string,expected_doc_type:string>>"
EXTENSIONS = {"application/pdf": [".pdf"], "image/png": [".png"], "image/jpeg": [".jpg", ".jpeg"]}
MOST_FILES, MOST_BYTES = 50, 25 * 1024 * 1024


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per recognised line of <sha256>.json files: document_sha256, page, line, text, bbox, confidence."""
    pages = spark.read.schema(FIXTURE).option("multiLine", True).json(folder).select("document_sha256", F.explode("pages").alias("p"))
    return pages.select("document_sha256", F.col("p.page").alias("page"), F.posexplode("p.lines").alias("line", "l")).select("document_sha256", "page", "line", "l.text", "l.bbox", "l.confidence")


def page_confidence(lines: DataFrame) -> DataFrame:
    """Mean and least confidence of each page, four places, half to even."""
    return lines.groupBy("document_sha256", "page").agg(F.bround(F.avg("confidence"), 4).alias("mean_confidence"), F.bround(F.min("confidence"), 4).alias("min_confidence"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size, sha256 and kind of the files of a folder.

    A scan leaves out files without a byte, so these are taken from the folder's listing: a batch is a few files.
    """
    files = spark.read.format("binaryFile").load(folder)
    found = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind(F.col("content")).alias("kind"))
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    empty = [(s.getPath().toString(), s.getPath().getName(), 0, hashlib.sha256().hexdigest(), "unknown") for s in listed if s.isFile() and s.getLen() == 0]
    return found.unionByName(spark.createDataFrame(empty, "path string, name string, size bigint, sha256 string, kind string"))


def kind(content: Column) -> Column:
    """Content type by leading bytes; the PDF mark may stand anywhere in the first 1024."""
    head = F.hex(F.substring(content, 1, 1024))
    return F.when(F.contains(head, F.lit("255044462D")), "application/pdf").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").otherwise("unknown")


def problems(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Why a batch of uploads is refused: one row per problem; none means that all of it is taken."""
    extensions = F.create_map(*(x for kind, names in EXTENSIONS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))))
    each = files.select("name", F.explode(F.array_compact(F.array(
        F.when(F.col("size") == 0, "empty"), F.when(F.col("size") > most_bytes, "too large"), F.when(F.col("kind") == "unknown", "unknown kind"),
        F.when((F.col("size") > 0) & ~F.coalesce(F.array_contains(F.try_element_at(extensions, F.col("kind")), F.lower(F.regexp_extract("name", r"[.][^.]*$", 0))), F.lit(True)), "extension differs"),
    ))).alias("problem"))
    many = files.agg(F.count("*").alias("n")).filter(F.col("n") > most_files).select(F.lit("*").alias("name"), F.lit("too many files").alias("problem"))
    return each.unionByName(many)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest; paths that leave its folder are refused (ok = false)."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")
    return rows.withColumn("ok", ~F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)"))


def verified(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries with their state: present, changed, missing or refused."""
    have = files.select(F.col("name").alias("filename"), F.col("sha256").alias("found"))
    state = F.when(~F.col("ok"), "refused").when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "present").otherwise("changed")
    return entries.join(have, "filename", "left").select("filename", "label", state.alias("state"))
