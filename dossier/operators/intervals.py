"""Interval joins without a nested loop; spans of a text that holds its own words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, key: list[str], width: int = 64) -> DataFrame:
    """Pairs of intervals [start, end) of one key that overlap: key, l and r (the rows' other columns).

    Both sides are cut into bins of ``width`` and joined on key and bin, so a key with very many intervals is as many
    groups as it has bins.  A pair is kept only in the bin in which the later of both begins, which is in both: nothing
    has to be made distinct.  Intervals without length overlap nothing; nulls are in no interval.
    """

    def cut(side: DataFrame, name: str) -> DataFrame:
        rest = F.struct(*(c for c in side.columns if c not in key)).alias(name)
        first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
        return side.filter("end > start").select(*key, rest, F.explode(F.sequence(first, last)).alias("bin"))

    met = cut(left, "l").join(cut(right, "r"), [*key, "bin"])
    begins, ends = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    return met.filter((begins < ends) & (F.floor(begins / width) == F.col("bin"))).select(*key, "l", "r")


#: Bytes of text that are cut into words at once (one text at least).
AT_ONCE = 1_000_000


def words_touched(texts: DataFrame, key: list[str]) -> DataFrame:
    """Spans of texts with the words they overlap: key, start, end, words (start, end, word, in order); spans without words are left out.

    texts: key, text and spans, an array of (start, end) in characters; a word is what stands between spaces.  A text's
    row has both sides, so its pairs are found there by search in sorted places: nothing is exploded, joined or shuffled.
    One text is held by one task.
    """
    given = texts.select(*key, "text", F.transform("spans", lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("spans"))

    def touched(rows: pa.RecordBatch) -> pa.RecordBatch:
        cut = pc.split_pattern(rows.column("text"), " ")
        words, texts_of = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        gone = np.cumsum(size + 1) - size - 1  # characters before a word, of all texts
        begin = gone - gone[np.searchsorted(texts_of, texts_of)]
        some = np.flatnonzero(size)
        begin, end, texts_of = begin[some], (begin + size)[some], texts_of[some]
        spans, at = rows.column("spans").flatten(), pc.list_parent_indices(rows.column("spans")).to_numpy()
        start, stop = (spans.field(side).to_numpy(zero_copy_only=False) for side in ("start", "end"))
        first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for text in np.unique(at):
            w, s = (slice(*np.searchsorted(of, (text, text + 1))) for of in (texts_of, at))
            first[s] = w.start + np.searchsorted(end[w], start[s], "right")
            last[s] = w.start + np.searchsorted(begin[w], stop[s], "left")
        hit = np.flatnonzero((last > first) & (stop > start))
        n = (last - first)[hit]
        offsets = np.r_[0, np.cumsum(n)]
        word = np.repeat(first[hit] - offsets[:-1], n) + np.arange(offsets[-1])
        found = pa.StructArray.from_arrays([pa.array(begin[word]), pa.array(end[word]), words.take(pa.array(some[word]))], names=["start", "end", "word"])
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(at[hit])) for c in key), pa.array(start[hit]), pa.array(stop[hit]), listed], names=[*key, "start", "end", "words"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
            begins = np.flatnonzero(np.r_[True, np.diff(part) > 0]) if len(part) else part
            for a, b in zip(begins, [*begins[1:], len(part)], strict=True):
                yield touched(batch.slice(a, b - a))

    columns = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in key)
    return given.filter("text is not null and spans is not null").mapInArrow(each, f"{columns}, start bigint, end bigint, words array<struct<start: bigint, end: bigint, word: string>>")
