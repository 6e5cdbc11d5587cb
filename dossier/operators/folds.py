"""Sequential operators: segmentation by windows and by a streamed fold, clustering, lifecycles composed from chunks."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, group: str, order: list[str], gap: Column) -> DataFrame:
    """Adds ``island``, from 0: a new one begins where ``gap`` (an expression over ``before``, the row before) holds."""
    w = Window.partitionBy(group).orderBy(*order)
    begins = F.when(gap, 1).otherwise(0)
    return rows.withColumn("island", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def segments(pages: DataFrame, group: str, page: str, reads_as: str, names_itself: str) -> DataFrame:
    """Segments of a file: group, segment, first_page, last_page, segment_type, n_ambiguous.

    In page order: a page that names its own type and differs from the open one begins a segment; a page
    that reads as the open type joins it; any other joins it as ambiguous (a null type is unknown: it begins
    nothing, and differs from every named one).  The open type is that of the last
    page that named itself (or of the first page), so running windows suffice and no array holds a file.
    """
    rows = pages.select(group, F.col(page).alias("page"), F.col(reads_as).alias("type"), F.col(names_itself).alias("named"))
    w = Window.partitionBy(group).orderBy("page")
    rows = rows.withColumn("opening", F.row_number().over(w) == 1)
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.last(F.when(F.col("opening") | F.col("named"), F.col("type")), ignorenulls=True).over(earlier))
    begins = F.col("opening") | (F.coalesce("named", F.lit(False)) & F.col("type").isNotNull() & ~F.col("type").eqNullSafe(F.col("open")))
    rows = rows.withColumn("begins", begins).withColumn("segment", F.sum(F.col("begins").cast("bigint")).over(so_far) - 1)
    strays = F.count_if(~F.col("begins") & ~F.coalesce(F.col("type") == F.col("open"), F.lit(False)))
    return rows.groupBy(group, "segment").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("type", "page").alias("segment_type"), strays.alias("n_ambiguous")
    )


#: What a page's placement rests on, where it begins a document and where it continues one.
BEGINS = ("first_page", "counter_restarted", "type_changed", "identifier_changed")
UNREADABLE = "other"


class _Open(NamedTuple):
    """What is known of the document that is open."""

    type: str = UNREADABLE
    identifiers: dict = {}
    total: int | None = None
    pages: int = 0


def _agrees(page: dict, doc: _Open) -> bool | None:
    """Whether page and document have the same value under the first label they share; None if they share none."""
    known = [(value, doc.identifiers[label]) for label, value in sorted(page["identifiers"].items()) if label in doc.identifiers]
    return known[0][0] == known[0][1] if known else None


#: Kinds of evidence, strongest first: the first that holds for a page and the open document places the page.
EVIDENCE = (
    ("first_page", lambda page, doc: doc is None),
    ("counter", lambda page, doc: page["at"] is not None and (page["at"] > 1 or doc.pages < (doc.total or 0))),
    ("counter_restarted", lambda page, doc: page["at"] is not None and (page["total"] or 0) >= 1),
    ("type_changed", lambda page, doc: page["named"] and page["type"] != doc.type),
    ("identifier_changed", lambda page, doc: _agrees(page, doc) is False),
    ("same_identifier", _agrees),
    ("same_type", lambda page, doc: page["named"] or UNREADABLE != page["type"] == doc.type),
    ("ambiguous", lambda page, doc: True),
)


def _with(page: dict, doc: _Open) -> _Open:
    """The document once the page is in it: the first to tell a type, an identifier or a total settles it."""
    names = page["type"] if page["named"] and doc.type == UNREADABLE else doc.type
    return _Open(names, page["identifiers"] | doc.identifiers, page["total"] if doc.total is None else doc.total, doc.pages + 1)


def placements(pages: DataFrame) -> DataFrame:
    """Where each page of a file belongs: file, page, segment (from 0), because.

    pages: file, page, type, named (it names its own type), identifiers (map of label to value, by label the
    first shared one counts), at and total ("page at of total", null if not printed).  Rows are sorted by
    file and page inside partitions and read as a stream; only the open document's facts are held, so a file
    of any length needs little memory.  Files of null name are one file; repeated page numbers follow by type.
    """
    rows = pages.select(
        F.col("file").cast("string"), F.col("page").cast("bigint"), F.coalesce("type", F.lit(UNREADABLE)).alias("type"), F.coalesce("named", F.lit(False)).alias("named"),
        F.map_entries(F.coalesce("identifiers", F.create_map().cast("map<string,string>"))).alias("identifiers"), F.col("at").cast("int"), F.col("total").cast("int"),
    )
    ordered = rows.repartition("file").sortWithinPartitions("file", "page", "type", "named", "at", "total")

    def run(batches):
        file, doc, segment = object(), None, -1
        for batch in batches:
            out = {name: [] for name in _PLACED.names}
            for page in batch.to_pylist():
                if page["file"] != file:
                    file, doc, segment = page["file"], None, -1
                page["identifiers"] = {e["key"]: e["value"] for e in page["identifiers"]}
                because = next(kind for kind, holds in EVIDENCE if holds(page, doc))
                begins = because in BEGINS
                doc, segment = _with(page, _Open() if begins else doc), segment + begins
                for name, value in zip(_PLACED.names, (file, page["page"], segment, because), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_PLACED)

    return ordered.mapInArrow(run, "file string, page bigint, segment bigint, because string")


_PLACED = pa.schema([("file", pa.string()), ("page", pa.int64()), ("segment", pa.int64()), ("because", pa.string())])


def placed_segments(pages: DataFrame) -> DataFrame:
    """Documents inside files by ``placements``: file, segment, first_page, last_page, because, n_ambiguous, uncertain."""
    found = placements(pages).groupBy("file", "segment").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.max(F.when(F.col("because").isin(*BEGINS), F.col("because"))).alias("because"), F.count_if(F.col("because") == "ambiguous").alias("n_ambiguous")
    )
    return found.withColumn("uncertain", F.col("n_ambiguous") > 0)


def anchored_clusters(rows: DataFrame, group: str, value: str, most: float) -> DataFrame:
    """Clusters of sorted values anchored to their first member: group, cluster, anchor, n.

    Equal values are counted first; then each group's values are read in order as a stream that holds the
    open anchor only.  Null values are in no cluster.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("key"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    key = counted.schema["key"].dataType.simpleString()

    def run(batches):
        at, anchor, cluster = object(), 0.0, -1
        for batch in batches:
            anchors, clusters = [], []
            for k, x in zip(batch["key"].to_pylist(), batch["x"].to_pylist(), strict=True):
                if k != at:
                    at, anchor, cluster = k, x, 0
                elif x - anchor > most:
                    anchor, cluster = x, cluster + 1
                anchors.append(anchor)
                clusters.append(cluster)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(clusters, pa.int64()), pa.array(anchors, pa.float64()), batch["n"]], ["key", "cluster", "anchor", "n"])

    read = counted.repartition("key").sortWithinPartitions("key", "x").mapInArrow(run, f"key {key}, cluster bigint, anchor double, n bigint")
    return read.groupBy("key", "cluster").agg(F.min("anchor").alias("anchor"), F.sum("n").alias("n")).withColumnRenamed("key", group)


def lifecycle(actions: DataFrame, key: str, order: list[str], action: str, start: str, moves: dict[str, tuple[tuple[str, ...], str]], chunk: int = 10_000) -> DataFrame:
    """Final status and count of refused actions per key: an action moves only from its allowed statuses.

    A key's log is cut into chunks of ``chunk`` actions; each becomes a map from every status it may begin
    with to the one it ends with, and the maps are composed in order, so no array holds a key's whole log.
    """
    statuses = sorted({start} | {t for _, t in moves.values()} | {x for sources, _ in moves.values() for x in sources})
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, action))
    cut = actions.select(key, F.col(action).alias("action"), place.alias("place")).withColumn("chunk", F.floor((F.col("place") - 1) / chunk))
    listed = cut.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "action"))).alias("log"))
    allowed = " ".join(f"WHEN a.action = '{name}' AND s.status IN ({', '.join(repr(x) for x in sources)}) THEN '{target}'" for name, (sources, target) in moves.items())
    fold = f"""transform(array({', '.join(map(repr, statuses))}), b -> aggregate(log, struct(b AS status, cast(0 AS bigint) AS refused), (s, a) ->
      struct(coalesce(CASE {allowed} END, s.status) AS status, s.refused + CASE WHEN CASE {allowed} END IS NULL THEN 1 ELSE 0 END AS refused)))"""
    part = F.struct("chunk", F.expr(fold).alias("ends"), F.size("log").cast("bigint").alias("n"))
    parts = listed.select(key, part.alias("part")).groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    at = f"element_at(p.ends, cast(array_position(array({', '.join(map(repr, statuses))}), s.status) AS int))"
    whole = f"""aggregate(parts, struct('{start}' AS status, cast(0 AS bigint) AS refused, cast(0 AS bigint) AS n),
      (s, p) -> struct({at}.status AS status, s.refused + {at}.refused AS refused, s.n + p.n AS n))"""
    return parts.select(key, F.expr(whole).alias("s")).select(key, "s.status", "s.refused", F.col("s.n").alias("n_actions"))
