"""Operator 10: substring dedup by recompression.

Every word in a ``window``-word sequence that also starts in a document with a smaller doc_id is removed.

Recompression shortens each text in rounds: runs of one token get one symbol, then the alphabet is split
in left and right by a bit of each symbol and every left-right pair gets one symbol.  A symbol is hashed
from what it stands for and a decision depends on neighbouring symbols only, so the interior of equal
substrings gets equal symbols in every task.  Beside each symbol goes its context, the words that its
forming depended on.  Windows are held by their highest symbol whose context lies inside them (with the
``gram`` words from its start); neighbouring windows with one symbol form a run.

Spark then names globally, in two rounds over ever fewer rows:

1. ``revealed``: all runs meet by their symbol.  A run that equals one of an earlier document is a repeat
   as a whole.  Of the others each symbol that stands in two documents gets a global name, and a symbol of
   one document alone takes its runs with it: no window that it holds can stand elsewhere.
2. ``verified``: the windows under a named symbol are pairs of that name and the window's own words; equal
   pairs are equal windows, and the ones in later documents are repeats.

Equality: 64 bits of the symbol, and XXH3 of 64 bits over the words of a run or the bytes of a window.

Defined results: null texts have no words; documents under ``window`` words lose nothing; repeats inside
one document stay; rows sharing a doc_id are documents of their own of which none is earlier than another;
very long texts are read in slices, very long words whole; extra columns, whatever their names, are
carried along in a struct; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import spans as S
from dossier.llm.common import Scratch, numbered, read

WINDOW = 13
#: Words that an anchor must have from its start on.
GRAM = 5
ROUNDS = 1
#: Rows of one bigint and one name up to which the named symbols go to every executor.
NAMED_ROWS = 500_000
U = np.uint64
FAR = 2**62


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 of each word, and each text's first word (n+1 bounds)."""
    raw, bounds, found = data.tobytes(), np.zeros(len(offsets), np.int64), []
    digest = xxhash.xxh3_64_intdigest
    for k, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        size = 0
        while a < z:  # parts of a very long text end at white space
            end = min(z, a + S.SLICE)
            while end < z and raw[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            own = np.array(list(map(digest, raw[a:end].split())), U)
            found.append(own)
            size, a = size + len(own), end
        bounds[k + 1] = bounds[k] + size
    return np.concatenate(found) if found else np.zeros(0, U), bounds


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    out = np.zeros(len(values), U)
    n = len(values) - gram + 1
    for k in range(gram):
        out[:n] = S.mix(out[:n] + values[k : k + n])
    return out


def recompress(name, start, low, high, row, k: int):
    """One round: runs, then pairs.  low, high: the words [low, high) that a symbol's forming depended on."""

    def beside(low, high, row):
        """The contexts of the symbols before and after; none at the ends of a text, which so count as outside of any window."""
        joined = row[1:] == row[:-1]
        before = np.r_[-FAR, np.where(joined, low[:-1], -FAR)], np.r_[FAR, np.where(joined, high[:-1], FAR)]
        after = np.r_[np.where(joined, low[1:], -FAR), -FAR], np.r_[np.where(joined, high[1:], FAR), FAR]
        return before, after, joined

    before, after, joined = beside(low, high, row)
    cut = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | ~joined])
    count = np.diff(np.r_[cut, len(name)])
    last = cut + count - 1
    name = np.where(count > 1, S.mix(name[cut] ^ S.mix(count.astype(np.uint64))), name[cut])
    low = np.minimum.reduce([np.minimum.reduceat(low, cut), before[0][cut], after[0][last]])
    high = np.maximum.reduce([np.maximum.reduceat(high, cut), before[1][cut], after[1][last]])
    start, row = start[cut], row[cut]

    before, after, joined = beside(low, high, row)
    is_right = (S.mix(name + U(k + 1)) >> U(63)).astype(bool)
    pair = np.r_[~is_right[:-1] & is_right[1:] & joined, False]
    first = np.flatnonzero(~np.r_[False, pair[:-1]])
    paired = pair[first]
    second = np.minimum(first + 1, len(name) - 1)
    # a pair depends on its two symbols; a right symbol on the one before it, a left one on the one after
    other = [np.where(paired, x[second], np.where(is_right[first], b[first], a[first])) for x, b, a in ((low, before[0], after[0]), (high, before[1], after[1]))]
    name = np.where(paired, S.mix(name[first] * U(3) ^ S.mix(name[second] + U(0x51ED))), name[first])
    return name, start[first], np.minimum(low[first], other[0]), np.maximum(high[first], other[1]), row[first]


def anchored_words(window: int, gram: int, rounds: int, step: int = 1 << 19):
    """Runs of windows under their highest symbol: symbol, mark, row, pos, d, n."""

    def run(data: np.ndarray, offsets: np.ndarray):
        values, bounds = word_names(data, offsets)
        none = np.zeros(0, np.int64)
        found = [(none,) * 6]
        n = len(values)
        if n < window:
            return found[0]
        place = np.arange(n)
        rows = np.searchsorted(bounds, place, "right") - 1
        grams = gram_hashes(values, gram)
        # on the grid of words: name, key and the offsets from a window's start at which a symbol counts, by level
        symbol = (values, place, place, place + 1, rows)
        grid = []
        for level in range(rounds + 1):
            if level:
                symbol = recompress(*symbol, level)
            name, start, low, high, _ = symbol
            names, keys = np.zeros(n, U), np.full(n, 2**64 - 1, U)
            least, most = np.full(n, 127, np.int8), np.full(n, -1, np.int8)
            names[start] = name
            keys[start] = (U(3 - min(level, 3)) << U(62)) | ((S.mix(grams[start] ^ name) >> U(2)) & ~U(0x3FFFFF))
            least[start] = np.clip(start - low, 0, 127)
            most[start] = np.clip(window - np.maximum(high - start, gram), -1, 126)
            grid.append((names, keys, least, most))
        raw, digest = memoryview(values.tobytes()), xxhash.xxh3_64_intdigest
        for at in range(0, n - window + 1, step):
            m = min(step, n - window + 1 - at)
            best = np.full(m, 2**64 - 1, U)
            for _, keys, least, most in grid:
                for o in range(window - gram + 1):
                    here = slice(at + o, at + o + m)
                    key = keys[here] | np.arange(o, o + m, dtype=U)
                    key[(least[here] > o) | (most[here] < o)] = U(2**64 - 1)
                    np.minimum(best, key, out=best)
            here = np.arange(at, at + m)
            anchor = (best & U(0x3FFFFF)).astype(np.int64)
            level = 3 - (best >> U(62)).astype(np.int64)
            # a run has one symbol: its windows agree on the place and on the level
            start, count = S.runs(here + window <= bounds[rows[here] + 1], anchor * 4 + level)
            if not len(start):
                continue
            a, level, first = at + anchor[start], level[start], at + start
            name = np.choose(np.minimum(level, rounds), [g[0][a] for g in grid])
            whole = np.array([digest(raw[8 * s : 8 * e]) for s, e in zip(first.tolist(), (first + count - 1 + window).tolist(), strict=True)], U)
            mark = S.mix(whole ^ S.mix((count * 4096 + (a - first)).astype(U)))
            row = rows[first]
            found.append((S.mix(grams[a] ^ S.mix(name)).view(np.int64), mark.view(np.int64), row, first - bounds[row], a - first, count))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return run


def entries(docs: DataFrame, window: int, gram: int, rounds: int) -> DataFrame:
    """Runs of the documents under their symbols, reduced within each task."""
    anchored = anchored_words(window, gram, rounds)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for some, data, offsets in S.slices(pa.Table.from_batches([b])):
                doc, twin = some.column("doc_id").to_numpy(), some.column("twin").to_numpy()
                symbol, mark, row, pos, d, n = anchored(data, offsets)
                yield symbol, mark, doc[row], twin[row], *(x.astype(np.int32) for x in (pos, d, n))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from S.reduced(found(batches), window, True)

    return docs.select("doc_id", "twin", "text").mapInArrow(task, S.ENTRY)


def revealed(docs: DataFrame, window: int, gram: int, rounds: int, scratch: Scratch, few: int) -> tuple[DataFrame, DataFrame]:
    """Runs (doc_id, twin, pos, n, name) under symbols that two documents share, and spans of runs that repeat as wholes."""
    part = F.when(F.expr(f"{S.KIND} = {S.SPAN}"), "spans").otherwise("runs")
    # what comes after asks a run for its symbol only
    table = scratch.write(S.settled(entries(docs, window, gram, rounds), window, True).drop("mark").withColumn("part", part), "symbols", by="part")
    runs = table.filter("part = 'runs'").select("key", "doc_id", "place", "flag")
    shared = runs.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    named = scratch.write(shared.select("key", F.monotonically_increasing_id().alias("name")), "names")
    live = runs.join(F.broadcast(named) if named.count() <= few else named, "key")
    live = live.select("doc_id", F.expr(S.TWIN).alias("twin"), F.expr(S.POS).alias("pos"), F.lit(0).alias("d"), F.expr(f"cast({S.N} as int)").alias("n"), "name")
    return live, S.spans_of(table.filter("part = 'spans'"))


def windows_of(window: int):
    """Name and XXH3 of the single windows under named symbols."""

    def spell(data, offsets, row, pos, d, n, name):
        texts, words, starts = data.tobytes(), {}, {}
        found, digest = [], xxhash.xxh3_64_intdigest
        for r, s, k in zip(row.tolist(), pos.tolist(), n.tolist(), strict=True):
            if r not in words:
                own = texts[offsets[r] : offsets[r + 1]].split()
                words[r], starts[r] = b" ".join(own), np.r_[0, np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)].tolist()
            joined, at = words[r], starts[r]
            found += [digest(joined[at[p] : at[p + window] - 1]) for p in range(s, s + k)]
        return np.repeat(name, n), np.array(found, U).view(np.int64), *S.singles(pos, n)

    return spell


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, rounds: int = ROUNDS, few: int = NAMED_ROWS) -> DataFrame:
    """text, row (the other columns), spans: the word spans (start, length) to be removed, null where there are none."""
    if not 0 < gram <= window < 127 or not 1 <= rounds <= 3:
        raise ValueError("gram must lie in 1..window and rounds in 1..3")
    scratch = Scratch(docs.sparkSession)
    docs = numbered(docs)
    live, spans = revealed(docs, window, gram, rounds, scratch, few)
    verified = S.settled(S.spelt_out(docs, live, windows_of(window), window, True), window, True)
    more = scratch.write(S.spans_of(verified), "windows")
    return S.with_spans(docs, spans.unionAll(more)).select("text", "row", "spans")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words removed, digest of the words that stay."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words, gone = (text or "").encode().split(), S.union_of(spans)
                kept, at = [], 0
                for start, end in gone:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("row.doc_id", "text", "spans").mapInArrow(task, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


#: The query by plain grouping of all windows.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) u(p)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, p + o AS q FROM hit, unnest(range(13)) v(o)),
each AS (SELECT doc_id, q, w[q] AS word FROM d, unnest(range(1, len(w) + 1)) u(q)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text FROM each ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
