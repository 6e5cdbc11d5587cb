"""Operator 4: suffix-array dedup with a logarithmic index family.

Every byte that lies in a ``window``-byte string which also starts earlier (in a smaller doc_id, or
earlier in the same document) is removed.  Matches never cross documents.

Documents come in batches in the order of doc_id.  A batch gets its suffix array: its sampled suffixes in
true byte order (range partitions, sorted inside), each with its leading HEAD bytes.  Suffixes are sampled
by content: of each window the least ``gram``-byte string, so that equal windows sample equal suffixes and
every window has one; a suffix stands for the run of windows that sampled it.  The batch is merge-scanned
against all existing levels: one pass in suffix order takes the common prefix of each suffix with its
neighbours.  Equal suffixes whose runs cover equal bytes are repeats as wholes, of others whose common
prefix is as long as a window needs the windows are contested, and a suffix with a shorter one is in no
long match.  Equal-sized levels and the batch then become one level of twice the size, so the family has
logarithmically many levels and a suffix is rewritten logarithmically often.  The contested runs of the
whole family are in the end settled in pieces of ``width`` windows, then one by one.

Equality: HEAD bytes as they are and a 64-bit XXH3 of all bytes of a run; of pieces a 64-bit XXH3 of all their
bytes and one of those that their windows share; of single windows a 128-bit XXH3.

Defined results: null and empty texts and texts under ``window`` bytes lose nothing (the empty text's
digest is that of no bytes); repeated rows are documents of their own, as are rows that share a doc_id, of
which none is earlier than another; very long texts are read in slices of 1 MB; extra columns, whatever
their names, are carried along in a struct; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import spans as S
from dossier.llm.common import Scratch, flat_bytes, numbered, read

WINDOW = 100
GRAM = 16
BATCHES = 4
#: Windows in a piece of a contested run.
WIDTH = 8
#: Rows of one bigint up to which the keys of pieces that stand several times go to every executor.
SHARED_ROWS = 500_000
#: Leading bytes of a suffix that a row carries.
HEAD = 32
ROW = "suffix binary, mark bigint, doc_id bigint, place bigint, flag int"
NAMES = ["suffix", "mark", "doc_id", "place", "flag"]
U = np.uint64
_rng = np.random.default_rng(20240229)
_values = _rng.integers(1, 2**63, 256, dtype=U)
_factor = 0x9E3779B97F4A7C15 | 1


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A number for each gram-byte string; it decides which suffixes are sampled and nothing else."""
    out = np.zeros(len(x) - gram + 1, U)
    own = _values[x]
    for k in range(gram):
        out *= U(_factor)
        out += own[k : k + len(out)]
    return S.mix(out)


def sampled(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, step: int = 1 << 20):
    """Head matrix and lengths, mark, row, pos, d, n of the runs of windows that sample the same suffix."""
    found = [(np.zeros((0, HEAD), np.uint8), *(np.zeros(0, np.int64) for _ in range(6)))]
    for at in range(0, len(data), step):
        x = data[at : at + step + window - 1]
        if len(x) < window:
            break
        keys = (gram_hashes(x, gram) & ~U(0xFFFFFF)) | np.arange(len(x) - gram + 1, dtype=U)
        anchor = (S.sliding_min(keys, window - gram + 1) & U(0xFFFFFF)).astype(np.int64)[:step]
        here = np.arange(len(anchor))
        row = np.searchsorted(offsets, at + here, "right") - 1
        start, n = S.runs(at + here + window <= offsets[row + 1], anchor)
        if not len(start):
            continue
        a, row, end = anchor[start], row[start], start + n - 1 + window
        size = np.minimum(HEAD, end - a)
        head = x[np.minimum(a[:, None] + np.arange(HEAD), len(x) - 1)]
        head[np.arange(HEAD) >= size[:, None]] = 0
        raw, digest = memoryview(x.tobytes()), xxhash.xxh3_64_intdigest
        whole = np.array([digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)], U)
        mark = S.mix(whole ^ S.mix((n * 4096 + (a - start)).astype(U))).view(np.int64)
        found.append((head, size, mark, row, at + start - offsets[row], a - start, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(head: np.ndarray, size: np.ndarray) -> pa.Array:
    data = head[np.arange(HEAD) < size[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data)])


def heads(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat_bytes(column)
    size = np.diff(offsets)
    head = np.zeros((len(size), HEAD), np.uint8)
    head[np.arange(HEAD) < size[:, None]] = data
    return head, size


def common_prefix(head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each row and the next one."""
    same = (head[1:] == head[:-1]) & (np.arange(HEAD) < np.minimum(size[1:], size[:-1])[:, None])
    return np.where(same.all(1), HEAD, np.argmin(same, axis=1))


def entries(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The sampled suffixes of the documents (part: rows), reduced within each task, and what repeats there (part: spans)."""

    def block(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        head, size, mark, doc, twin, pos, d, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, twin, doc, mark))
        mark_, doc_, twin_ = mark[order], doc[order], twin[order]
        same = (mark_[1:] == mark_[:-1]) & (head[order[1:]] == head[order[:-1]]).all(1)
        again = S.repeated(np.r_[True, ~same][: len(mark)], doc_, twin_, False)
        keep, gone = order[~again], order[again]
        words = np.ascontiguousarray(head[keep][:, :8]).view(">u8")[:, 0]
        keep = keep[np.argsort(words)]
        columns = (mark[keep], doc[keep], pos[keep] << 31 | d[keep] << 12 | n[keep], (twin[keep] << 2 | S.FRESH).astype(np.int32))
        part = pa.array(["rows"] * len(keep), pa.string())
        yield pa.RecordBatch.from_arrays([suffix_array(head[keep], size[keep]), *(pa.array(c) for c in columns), part], [*NAMES, "part"])
        doc, twin, pos, length = S.spans_merged(doc[gone], twin[gone], pos[gone], n[gone] + window - 1)
        yield span_rows(doc, twin, pos, length)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in batches:
            for some, data, offsets in S.slices(pa.Table.from_batches([b])):
                doc, twin = some.column("doc_id").to_numpy(), some.column("twin").to_numpy()
                head, size, mark, row, pos, d, n = sampled(data, offsets, window, gram)
                parts.append((head, size, mark, doc[row], twin[row].astype(np.int64), pos, d, n))
                rows += len(row)
                if rows >= S.BLOCK:
                    yield from block(parts)
                    parts, rows = [], 0
        if parts:
            yield from block(parts)

    return docs.select("doc_id", "twin", "text").mapInArrow(task, f"{ROW}, part string")


def span_rows(doc, twin, pos, length) -> pa.RecordBatch:
    columns = (np.zeros(len(doc), np.int64), doc, pos << 31 | length, (twin << 2 | S.SPAN).astype(np.int32))
    part = pa.array(["spans"] * len(doc), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([b""] * len(doc), pa.binary()), *(pa.array(c) for c in columns), part], [*NAMES, "part"])


def scanned(rows: DataFrame, window: int, last: bool) -> DataFrame:
    """One merge scan in suffix order.  part: spans, and level (all that stays first) or, of the last one, contested.

    Borders of partitions count as long matches: their rows are contested whether they match or not.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the first row of the open key and the last row
        waiting: tuple | None = None  # the last row that stays, and its common prefix with the one before

        def staying(head, size, before, after, mark, doc, place, flag) -> pa.RecordBatch:
            d, n = place >> 12 & 524287, place & 4095
            if not last:
                take = np.flatnonzero((flag & 3) != S.LOOKED_UP)
                flag, part = flag & -4 | S.LEVEL, "level"
            else:
                longest = np.maximum(before, after)
                # windows that begin d bytes before the suffix need window - d common bytes; HEAD says nothing of more
                n = np.where(longest < HEAD, np.clip(d - window + longest + 1, 0, n), np.where(d >= 0, n, 0))
                take, part = np.flatnonzero(n > 0), "contested"
                place = (place >> 12 << 12) | n
                size = np.zeros_like(size)
            columns = (mark[take], doc[take], place[take], flag[take].astype(np.int32))
            return pa.RecordBatch.from_arrays([suffix_array(head[take], size[take]), *(pa.array(c) for c in columns), pa.array([part] * len(take), pa.string())], [*NAMES, "part"])

        for b in batches:
            head, size = heads(b.column("suffix"))
            rest = [b.column(c).to_numpy() for c in NAMES[1:]]
            k = 0
            if held is not None:
                k = 2
                head, size, *rest = (np.concatenate([h, x]) for h, x in zip(held, (head, size, *rest), strict=True))
            if len(size) == k:
                continue
            mark, doc, place, flag = rest
            twin = flag >> 2
            same = (mark[1:] == mark[:-1]) & (size[1:] == size[:-1]) & (head[1:] == head[:-1]).all(1)
            new = np.r_[True, ~same]
            again = S.repeated(new, doc, twin, False)
            own = [np.flatnonzero(new)[-1], len(size) - 1]
            held = tuple(x[own] for x in (head, size, mark, doc, place, flag))
            again[:k] = False
            gone = again & ((flag & 3) == S.FRESH)
            yield span_rows(*S.spans_merged(doc[gone], twin[gone].astype(np.int64), place[gone] >> 31, (place[gone] & 4095) + window - 1))
            stay = ~again
            stay[:k] = False
            now = tuple(x[stay] for x in (head, size, mark, doc, place, flag))
            if not len(now[1]):
                continue
            before = np.full(1, HEAD)
            if waiting is not None:
                before = waiting[1]
                now = tuple(np.concatenate([w, x]) for w, x in zip(waiting[0], now, strict=True))
            shared = common_prefix(now[0], now[1])
            before = np.r_[before, shared]
            yield staying(now[0][:-1], now[1][:-1], before[:-1], shared, *(x[:-1] for x in now[2:]))
            waiting = tuple(x[-1:] for x in now), before[-1:]
        if waiting is not None:
            row = waiting[0]
            yield staying(row[0], row[1], waiting[1], np.full(1, HEAD), *row[2:])

    ordered = rows.repartitionByRange("suffix", "mark").sortWithinPartitions("suffix", "mark", "doc_id", "flag", "place")
    return ordered.mapInArrow(task, f"{ROW}, part string")


def build(docs: DataFrame, window: int, gram: int, batches: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Contested runs (doc_id, twin, pos, d, n) of the index family over all documents, and the spans found while it grew."""
    cuts = sorted(set(docs.stat.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    union = lambda frames: functools.reduce(DataFrame.unionAll, frames)
    family: list[tuple[int, str, DataFrame]] = []
    spans: list[DataFrame] = []
    of = lambda table, part: table.filter(F.col("part") == part).select(*NAMES)
    for k in range(len(cuts) + 1):
        part = docs
        if k:
            part = part.filter(F.col("doc_id") > int(cuts[k - 1]))
        if k < len(cuts):
            part = part.filter(F.col("doc_id") <= int(cuts[k]))
        batch = scratch.write(entries(part, window, gram), f"batch-{k}", by="part")
        spans.append(of(batch, "spans"))
        size, merging = 0, []
        while family and family[-1][0] == size:
            merging.append(family.pop())
            size += 1
        if k == len(cuts):  # nothing comes after: what is left of the family becomes one level
            merging, family = merging + family, []
        rows = union([of(batch, "rows"), *(level for _, _, level in merging), *(level.withColumn("flag", F.expr(f"flag | {S.LOOKED_UP}")) for _, _, level in family)])
        table = scratch.write(scanned(rows, window, k == len(cuts)), f"level-{k}", by="part")
        scratch.drop(f"batch-{k}/part=rows", *(f"{name}/part=level" for _, name, _ in merging))
        spans.append(of(table, "spans"))
        family.append((size, f"level-{k}", of(table, "level")))
    contested = of(table, "contested").select("doc_id", F.expr(S.TWIN).alias("twin"), F.expr(S.POS).alias("pos"), F.expr(f"cast({S.D} as int)").alias("d"), F.expr(f"cast({S.N} as int)").alias("n"))
    return contested, S.spans_of(union(spans))


def digests_of(window: int):
    """128-bit digests of single windows."""

    def spell(data, offsets, row, pos, d, n, name):
        raw, digest = memoryview(data.tobytes()), xxhash.xxh3_128_digest
        found = [digest(raw[p : p + window]) for s, k in zip((offsets[row] + pos).tolist(), n.tolist(), strict=True) for p in range(s, s + k)]
        both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1], *S.singles(pos, n)

    return spell


def narrower(window: int, width: int):
    """Contested runs in pieces of at most ``width`` windows whose distances to the suffix have one quotient by it.

    The key is a digest of the bytes that all such windows share and of the quotient, so equal windows stay in
    pieces of equal keys; the mark is a digest of all bytes of the piece.
    """

    def spell(data, offsets, row, pos, d, n, name):
        raw, digest = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
        run, first, _ = S.singles(pos, n)
        behind = d[run] - (first - pos[run])
        quotient = behind // width
        cut = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (quotient[1:] != quotient[:-1])][: len(run)])
        size = np.diff(np.r_[cut, len(run)])
        run, first, behind, quotient = run[cut], first[cut], behind[cut], quotient[cut]
        start = offsets[row[run]] + first
        latest = start + behind - quotient * width  # where the last window of a full piece begins
        key = np.array([digest(raw[s : s + window - width + 1]) for s in latest.tolist()], U)
        mark = np.array([digest(raw[s:e]) for s, e in zip(start.tolist(), (start + size - 1 + window).tolist(), strict=True)], U)
        key, mark = S.mix(key ^ S.mix(quotient.astype(U))), S.mix(mark ^ S.mix((size * 4096 + latest - start).astype(U)))
        return key.view(np.int64), mark.view(np.int64), run, first, size

    return spell


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, width: int = WIDTH, few: int = SHARED_ROWS) -> DataFrame:
    """text, row (the other columns), spans: the byte spans (start, length) to be removed, null where there are none."""
    if not 0 < gram <= window < 4096 or not 0 < width <= window:
        raise ValueError("gram must lie in 1..window, window under 4096 and width in 1..window")
    scratch = Scratch(docs.sparkSession)
    docs = numbered(docs)
    contested, spans = build(docs, window, gram, batches, scratch)
    pieces = S.settled(S.spelt_out(docs, contested.withColumn("name", F.lit(0).cast("bigint")), narrower(window, width), window, False), window, False)
    part = F.when(F.expr(f"{S.KIND} = {S.SPAN}"), "spans").otherwise("pieces")
    pieces = scratch.write(pieces.drop("mark").withColumn("part", part), "pieces", by="part")
    left = pieces.filter("part = 'pieces'").select("key", "doc_id", "place", "flag")
    shared = scratch.write(left.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "shared")
    left = left.join(F.broadcast(shared) if shared.count() <= few else shared, "key", "left_semi")
    left = left.select("doc_id", F.expr(S.TWIN).alias("twin"), F.expr(S.POS).alias("pos"), F.lit(0).alias("d"), F.expr(f"cast({S.N} as int)").alias("n"), F.lit(0).cast("bigint").alias("name"))
    # what stays first is of no more use
    single = scratch.write(S.spans_of(S.settled(S.spelt_out(docs, left, digests_of(window), window, False), window, False)), "windows")
    return S.with_spans(docs, spans.unionAll(S.spans_of(pieces)).unionAll(single)).select("text", "row", "spans")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and runs removed, digest of the rest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data, gone, at = (text or "").encode(), S.union_of(spans), 0
                kept = hashlib.sha256()
                for start, end in gone:
                    kept.update(data[at:start])
                    at = end
                kept.update(data[at:])
                out.append((doc, len(data), sum(e - s for s, e in gone), len(gone), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("row.doc_id", "text", "spans").mapInArrow(task, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """The documents with their repeats cut out of ``text`` at whole characters, ``n_chars`` counted anew.

    A character goes if all its bytes are to be removed.  Other columns are kept as they are.
    """
    names, schema = docs.columns, docs.schema
    found = remove_repeats(docs, window, gram, batches)

    def cut(text: str | None, spans: list[dict] | None) -> str | None:
        if text is None or not spans:
            return text
        data, out, at = text.encode(), [], 0
        for start, end in S.union_of(spans):
            while start < end and data[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(data[at:start])
            at = max(at, end)
        return b"".join([*out, data[at:]]).decode()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            row = {f.name: c for f, c in zip(b.column("row").type, b.column("row").flatten(), strict=True)}
            row["text"] = pa.array(texts, pa.string())
            if "n_chars" in row:
                row["n_chars"] = pa.array([None if t is None else len(t) for t in texts], row["n_chars"].type)
            yield pa.RecordBatch.from_arrays([row[n] for n in names], names)

    return found.mapInArrow(task, schema)


#: The query by plain grouping of all windows, texts in hex.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 200)) AS k FROM d, unnest(range(greatest(len(h) // 2 - 99, 0))) u(p)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
cut AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS begins FROM hit),
isle AS (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM cut),
span AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM isle GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, coalesce(lag(e) OVER w, 0) AS a, s AS b FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, max(e), NULL FROM span GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS n FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
