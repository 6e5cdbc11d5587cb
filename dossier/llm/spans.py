"""Rows of windows and spans of repeats: helpers of the two exact repeat removers.

A row stands for ``n`` windows that begin at ``pos``, ``pos + 1``, ... of one document (``doc_id`` and
``twin``); a span is a stretch that is to be removed.  Null texts are empty, a null doc_id counts as the
largest id, rows that share a doc_id are documents of their own and none of them is earlier than another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import flat_bytes

#: Kinds of rows: a candidate, a span known to repeat, a row of a level, a row of a level that is only looked up.
FRESH, SPAN, LEVEL, LOOKED_UP = range(4)
#: place is pos << 31 | length of a span and pos << 31 | d << 12 | n of others (a text has under 2**31 units, a
#: window under 4096); d is how far behind pos the anchor stands; flag is twin << 2 | kind.
KIND, TWIN, POS, N, D, LENGTH = "flag & 3", "flag >> 2", "place >> 31", "place & 4095", "place >> 12 & 524287", "place & 2147483647"
#: Bytes of text handled at once inside a task, and rows reduced at once.
SLICE = 1 << 20
BLOCK = 150_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(table: pa.Table, limit: int = SLICE) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in groups of about ``limit`` bytes, at least one row each, with bytes and offsets of their texts."""
    data, offsets = flat_bytes(table.column("text"))
    first = 0
    while first < table.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield table.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, n = 1, len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def runs(valid: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and width of each run of consecutive valid windows with one anchor."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (anchor[at[1:]] != anchor[at[:-1]])])
    return at[cut], np.diff(np.r_[cut, len(at)])


def spans_merged(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Overlapping and touching spans of a document as one."""
    if not len(doc):
        return doc, twin, start, length
    order = np.lexsort((start, twin, doc))
    doc, twin, start, end = doc[order], twin[order], start[order], (start + length)[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])]
    # the furthest end so far inside the document: ends are raised by a document's number times a bound
    group = np.cumsum(fresh) - 1
    bound = int(end.max()) + 1
    far = np.maximum.accumulate(end + group * bound) - group * bound
    cut = np.flatnonzero(np.r_[True, fresh[1:] | (start[1:] > far[:-1])])
    return doc[cut], twin[cut], start[cut], far[np.r_[cut[1:], len(doc)] - 1] - start[cut]


def repeated(new: np.ndarray, doc: np.ndarray, twin: np.ndarray, across: bool) -> np.ndarray:
    """Which rows, sorted by key, doc, twin and place, have an earlier one of their key (``new``: a key begins).

    across: only one in a document of a smaller id; else also one in the same document.
    """
    if not len(new):
        return np.zeros(0, bool)
    again = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
    if not across:
        again[1:] |= ~new[1:] & (doc[1:] == doc[:-1]) & (twin[1:] == twin[:-1])
    return again


ENTRY = "key bigint, mark bigint, doc_id bigint, place bigint, flag int"


def entry_batch(key, mark, doc, twin, pos, low, kind: int) -> pa.RecordBatch:
    columns = (key, mark, doc, pos.astype(np.int64) << 31 | low.astype(np.int64), (twin << 2 | kind).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "mark", "doc_id", "place", "flag"])


def spans_batch(doc, twin, pos, length) -> pa.RecordBatch:
    """Spans of one task as rows; their key spreads them over the partitions."""
    doc, twin, pos, length = spans_merged(doc, twin, pos.astype(np.int64), length)
    return entry_batch(mix(doc.view(np.uint64)).view(np.int64), pos, doc, twin, pos, length, SPAN)


def reduced(found: Iterator[tuple], window: int, across: bool) -> Iterator[pa.RecordBatch]:
    """Of the rows (key, mark, doc, twin, pos, d, n) of a task, block by block, the first ones of each key; the rest as spans."""

    def block(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, mark, doc, twin, pos, d, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, twin, doc, mark, key))
        key, mark, doc, twin, pos, d, n = (x[order] for x in (key, mark, doc, twin, pos, d, n))
        again = repeated(np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])][: len(key)], doc, twin, across)
        keep = ~again
        yield entry_batch(key[keep], mark[keep], doc[keep], twin[keep], pos[keep], d[keep].astype(np.int64) << 12 | n[keep], FRESH)
        yield spans_batch(doc[again], twin[again], pos[again], n[again].astype(np.int64) + window - 1)

    parts, rows = [], 0
    for part in found:
        parts.append(part)
        rows += len(part[0])
        if rows >= BLOCK:
            yield from block(parts)
            parts, rows = [], 0
    if parts:
        yield from block(parts)


def settled(rows: DataFrame, window: int, across: bool) -> DataFrame:
    """The rows of each key that have no earlier one (FRESH) and the spans of those that have.

    A key's rows come sorted and are read in one stream: nothing is held but the key's first row and the last one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            key, mark, doc, place, flag = (b.column(c).to_numpy() for c in ("key", "mark", "doc_id", "place", "flag"))
            span = (flag & 3) == SPAN
            if span.any():
                yield entry_batch(key[span], mark[span], doc[span], flag[span] >> 2, place[span] >> 31, place[span] & 2147483647, SPAN)
                key, mark, doc, place, flag = (x[~span] for x in (key, mark, doc, place, flag))
            if not len(key):
                continue
            before = 0
            if held is not None:
                before = len(held[0])
                key, mark, doc, place, flag = (np.r_[h, x] for h, x in zip(held, (key, mark, doc, place, flag), strict=True))
            new = np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]
            twin = flag >> 2
            again = repeated(new, doc, twin, across)
            first = np.flatnonzero(new)[-1]
            held = tuple(x[[first, -1]] for x in (key, mark, doc, place, flag))
            keep, again = ~again, again.copy()
            keep[:before] = again[:before] = False
            yield entry_batch(key[keep], mark[keep], doc[keep], twin[keep], place[keep] >> 31, place[keep] & 2147483647, FRESH)
            yield spans_batch(doc[again], twin[again], place[again] >> 31, (place[again] & 4095) + window - 1)

    ordered = rows.repartition("key", "mark").sortWithinPartitions("key", "mark", "doc_id", "flag", "place")
    return ordered.mapInArrow(task, ENTRY)


def spans_of(rows: DataFrame) -> DataFrame:
    """doc_id, twin, start, length of the rows that are spans."""
    return rows.filter(f"({KIND}) = {SPAN}").select("doc_id", F.expr(TWIN).alias("twin"), F.expr(POS).alias("start"), F.expr(LENGTH).alias("length"))


def spelt_out(docs: DataFrame, some: DataFrame, spell: Callable, window: int, across: bool) -> DataFrame:
    """Runs of windows in smaller pieces as rows, reduced within each task.

    some: doc_id, twin, pos, d, n, name of runs of windows.  spell(data, offsets, row, pos, d, n, name) gives key, mark, number of
    the run, pos and n of each piece.
    """
    gathered = some.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("pos", "d", "n", "name")).alias("runs"))  # bounded by a document

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for rows, data, offsets in slices(pa.Table.from_batches([b])):
                lists = rows.column("runs").combine_chunks()
                row = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
                columns = [np.asarray(lists.flatten().field(c)) for c in ("pos", "d", "n", "name")]
                doc, twin = rows.column("doc_id").to_numpy(), rows.column("twin").to_numpy()
                cuts = np.r_[np.flatnonzero(np.diff(np.cumsum(columns[2]) // BLOCK, prepend=-1)), len(row)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    key, mark, run, pos, n = spell(data, offsets, row[a:z], *(c[a:z] for c in columns))
                    own = row[a:z][run]
                    yield key, mark, doc[own], twin[own], pos.astype(np.int64), np.zeros(len(own), np.int32), n.astype(np.int32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(found(batches), window, across)

    return docs.select("doc_id", "twin", "text").join(gathered, ["doc_id", "twin"]).mapInArrow(task, ENTRY)


def singles(pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of runs: number of the run, pos and n = 1."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + pos[run], np.ones(len(run), np.int32)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The numbered documents with spans (start, length in units), sorted; null where nothing repeats."""
    gathered = spans.groupBy("doc_id", "twin").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    return docs.join(gathered, ["doc_id", "twin"], "left")


def union_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed stretches (start, end) of a sorted list of spans."""
    out: list[list[int]] = []
    for s in spans or ():
        start, end = s["start"], s["start"] + s["length"]
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]
