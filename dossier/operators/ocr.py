"""Rows, words and text lines from recognised boxes.

A box (key columns, seq, text, left, top, right, bottom, confidence) is one run of text in page units, origin at the top.
Boxes in order of top, then left, join the first row whose last box they share half a height with and no width; each
box of a row becomes a column of its line.

A page is cut into bands wherever a box begins below everything before it: no row can reach across.  Bands are dealt
out on their own, so one long page is many tasks' work, and within a band a task holds only rows that can still grow.
Where a page's boxes come as one array (``page_lines``), all of it is done in the page's row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes given as shares of the page, in page units."""
    return boxes.withColumns({"left": F.col("left") * width, "right": F.col("right") * width, "top": F.col("top") * height, "bottom": F.col("bottom") * height})


def banded(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``band``: how many times before a box its page has begun anew below everything above."""
    order = Window.partitionBy(*key).orderBy("top", "left", "seq")
    floor = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    below = boxes.withColumn("below", F.coalesce(F.col("top") > floor, F.lit(False)).cast("long"))
    return below.withColumn("band", F.sum("below").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("below")


class Fold:
    """Numbers the rows of one page or band, box by box in the order of top, left and seq."""

    def __init__(self):
        self.open, self.begun = [], 0  # open: [row, left, top, right, bottom] of last boxes

    def place(self, left: float, top: float, right: float, bottom: float) -> int:
        self.open = [r for r in self.open if r[4] >= top]
        for r in self.open:
            beside = min(right, r[3]) <= max(left, r[1])
            if beside and min(bottom, r[4]) - max(top, r[2]) >= 0.5 * min(bottom - top, r[4] - r[2]):
                r[1:] = left, top, right, bottom
                return r[0]
        self.open.append([self.begun, left, top, right, bottom])
        self.begun += 1
        return self.begun - 1


def rows(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``band`` and ``row``: rows of a band are numbered from 0 in the order in which they begin."""
    cut = banded(boxes, key)
    fields = [f.name for f in cut.schema]
    place = [fields.index(c) for c in (*key, "band")]
    box = [fields.index(c) for c in ("left", "top", "right", "bottom")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, page = None, Fold()
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in place), strict=True)
            given = []
            for now, sides in zip(keys, zip(*(batch.column(i).to_pylist() for i in box), strict=True), strict=True):
                if now != at:
                    at, page = now, Fold()
                given.append(page.place(*sides))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(given, pa.int64())], names=[*fields, "row"])

    dealt = cut.repartition(*key, "band").sortWithinPartitions(*key, "band", "top", "left", "seq")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.mapInArrow(fold, f"{columns}, row bigint")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def _each(tokens: Column, left: Column, right: Column) -> Column:
    """Width of a character of a box."""
    return F.greatest(right - left, F.lit(1.0)) / F.greatest(F.length(F.array_join(tokens, " ")), F.lit(1))


def _words(box, tokens: Column, each: Column) -> Column:
    """The words of a box (a function from names to columns)."""

    def word(token: Column, i: Column) -> Column:
        # characters before a word: those of the words before it, with a space after each
        begin = box("left") + each * (F.length(F.array_join(F.slice(tokens, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0))
        end = F.least(begin + each * F.length(token), box("right"))
        return F.struct(token.alias("text"), begin.alias("left"), box("top").alias("top"), end.alias("right"), box("bottom").alias("bottom"), box("confidence").cast("double").alias("confidence"))

    return F.transform(tokens, word)


def words_of(boxes: DataFrame) -> DataFrame:
    """Adds ``words``, the words of each box with boxes of their own: its width is shared out by characters, spaces included."""
    found = boxes.withColumn("tokens", _tokens(F.col("text"))).withColumn("each", _each(F.col("tokens"), F.col("left"), F.col("right")))
    return found.withColumn("words", _words(F.col, F.col("tokens"), F.col("each"))).drop("tokens", "each")


def union(words: Column) -> Column:
    """The box around words."""
    edge = lambda pick, side: pick(F.transform(words, lambda w: w[side]))
    return F.struct(edge(F.array_min, "left").alias("left"), edge(F.array_min, "top").alias("top"), edge(F.array_max, "right").alias("right"), edge(F.array_max, "bottom").alias("bottom"))


def mean_confidence(words: Column) -> Column:
    """Mean confidence of the words that have one, four places; null if none has."""
    known = F.filter(F.transform(words, lambda w: w.confidence), lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.bround(F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known), 4))


def lines(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Text lines: key columns, line (from 0, rows without words left out), text, words, box, confidence.

    Boxes of a row stand in order of left and are two spaces apart, words of a box one space.
    """
    found = words_of(rows(boxes, key))
    run = F.struct("left", "top", "seq", F.array_join(F.transform("words", lambda w: w.text), " ").alias("text"), "words")
    placed = found.filter(F.size("words") > 0).groupBy(*key, "band", "row").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    line = F.row_number().over(Window.partitionBy(*key).orderBy("band", "row")) - 1
    return _read(placed.withColumn("line", line.cast("long")), key)


def _read(placed: DataFrame, key: list[str]) -> DataFrame:
    """Lines from their runs in order (text and words)."""
    words, text = F.flatten(F.transform("runs", lambda r: r["words"])), F.array_join(F.transform("runs", lambda r: r.text), "  ")
    return placed.select(*key, "line", text.alias("text"), words.alias("words")).withColumns({"box": union(F.col("words")), "confidence": mean_confidence(F.col("words"))})


#: A box inside a page's array.
BOX = "top double, left double, seq bigint, right double, bottom double, text string, confidence double"


def page_lines(pages: DataFrame, key: list[str]) -> DataFrame:
    """The lines of pages whose ``boxes`` are one array of structs (fields as of a box): as ``lines``, without a shuffle.  One page is held by one task."""
    names = [c.split()[0] for c in BOX.split(", ")]
    one = lambda b: F.struct(*(b[n].cast(t).alias(n) for n, t in (c.split() for c in BOX.split(", "))))
    thin = pages.filter(F.size("boxes") > 0).select(*key, F.array_sort(F.transform("boxes", one)).alias("boxes"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes, listed = batch.column("boxes").flatten(), batch.column("boxes")
            page = pc.list_parent_indices(listed).to_numpy()
            left, top, right, bottom = (boxes.field(names.index(n)).to_pylist() for n in ("left", "top", "right", "bottom"))
            given, at, open_page = np.zeros(len(boxes), np.int64), -1, Fold()
            for k, now in enumerate(page.tolist()):
                if now != at:
                    at, open_page = now, Fold()
                given[k] = open_page.place(left[k], top[k], right[k], bottom[k])
            # rows without words are no lines; boxes of a row in order of left, then as they stand
            said = np.array([bool(t and t.strip(" ")) for t in boxes.field(names.index("text")).to_pylist()], bool)
            order = np.lexsort((np.arange(len(boxes)), np.array(left), given, page))
            order = order[said[order]]
            if not len(order):
                continue
            begins = np.flatnonzero(np.r_[True, (np.diff(page[order]) != 0) | (np.diff(given[order]) != 0)])
            of_page = page[order][begins]
            line = np.arange(len(begins)) - np.searchsorted(of_page, of_page)
            runs = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(order)], pa.int32()), boxes.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of_page)) for c in key), pa.array(line, pa.int64()), runs], names=[*key, "line", "boxes"])

    columns = ", ".join(f"`{c}` {thin.schema[c].dataType.simpleString()}" for c in key)
    typed = ", ".join(c.replace(" ", ": ") for c in BOX.split(", "))
    found = thin.mapInArrow(fold, f"{columns}, line bigint, boxes array<struct<{typed}>>")
    cut = found.withColumn("boxes", F.transform("boxes", lambda b: F.struct(b.alias("b"), _tokens(b.text).alias("tokens"))))
    cut = cut.withColumn("boxes", F.transform("boxes", lambda x: x.withField("each", _each(x.tokens, x.b.left, x.b.right))))
    run = lambda x: F.struct(F.array_join(x.tokens, " ").alias("text"), _words(lambda n: x.b[n], x.tokens, x.each).alias("words"))
    return _read(cut.withColumn("runs", F.transform("boxes", run)), key)
