"""Operator 2: best-fit packing of token sequences.

Documents become token ids (the tokenizer's, then id 0); only those over ``capacity`` are cut, into pieces
of that many.  Best-fit decreasing looks at sizes alone, and there are at most ``capacity`` of them, so it
runs on the histogram of sizes: for each size, largest first, a segment tree over remaining capacities
finds the tightest open bins that fit in logarithmic time, and as many equal bins as there are take their
share at once.  That is exactly what placing document by document does.  Its result, a bounded table of
which ranks of a size go to which bins, is sent to all tasks; ranks come from salted groups, so neither
the driver nor a task sees all documents.

Defined results: null and empty texts are the one id 0; repeated rows are packed as often as they occur;
an empty table gives no rows.  Sequence ids run from 0 without gaps.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm.common import Scratch, join_checked, read

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = 0
#: Words whose ids a worker remembers, at most.
CACHE = 600_000
#: Rows of one size ranked together.
RANKED = 2_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Texts with these go to the tokenizer whole: separators that are white space to Python but not to it, its special
#: tokens, and the two letters that it lowers otherwise.
_odd = re.compile("[\x1c-\x1fΣİ]|<\\|")
#: Words of these characters, lowered, are split as the tokenizer's pattern does and mapped to its byte letters here.
_plain = re.compile("[!-~¡-ɏ]+")
_part = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼-¾]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for letters from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) if b in kept else chr(256 + moved.index(b)) for b in range(256)}


class Ids(dict):
    """Ids of words, then of whole texts, as packed 32-bit integers.

    This tokenizer drops white space and never looks across it, so ids are remembered word by word, and a
    plain word's parts go straight to its model.  What is not plain goes through the whole tokenizer;
    tests/llm holds both ways against each other.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        self.letters = byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if _plain.fullmatch(word):
            parts = (p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in _part.findall(word))
            found = b"".join(t.id.to_bytes(4, "little") for p in parts for t in self.split(p))
        else:
            found = self.whole(word)
        self[word] = found
        return found

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        for k, text in enumerate(texts):
            if not k % 64 and len(self) > CACHE:
                self.clear()
            text = text or ""
            yield self.whole(text) if _odd.search(text) else b"".join(map(self.__getitem__, text.lower().split()))


_known: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One memory per worker and vocabulary: what a worker's earlier tasks have met stays known."""
    if path not in _known:
        _known[path] = Ids(path)
    return _known[path]


def tokenized(docs: DataFrame, capacity: int, path: str, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, data in zip(b.column("doc_id").to_pylist(), ids.of(b.column("text").to_pylist()), strict=True):
                data += tail
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    some = data[at : at + 4 * capacity]
                    doc.append(doc_id), piece.append(k), start.append(at // 4), length.append(len(some) // 4), crc.append(zlib.crc32(some))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(task, PIECE)


class Tightest:
    """Segment tree over remaining capacities: the least one at or above a size that has open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        k = remaining + self.size
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] | self.open[2 * k + 1]

    def at_least(self, size: int) -> int | None:
        k = size + self.size
        if self.open[k]:
            return size
        while k > 1:  # up until a right sibling has something, then down its left edge
            if not k & 1 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (size, first rank, ranks, first bin, per bin, offset) and the number of bins.

    Of one placement, rank first+i goes to bin first_bin + i // per_bin at offset + size * (i % per_bin).
    """
    tree, bins = Tightest(capacity), 0
    stock: dict[int, list[tuple[int, int]]] = {}
    placed = []

    def put(remaining: int, first: int, count: int) -> None:
        if remaining > 0 and count > 0:
            stock.setdefault(remaining, []).append((first, count))
            tree.set(remaining, True)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            remaining = tree.at_least(size)
            if remaining is None:
                remaining, first, count = capacity, bins, -(-left // (capacity // size))
                bins += count
            else:
                first, count = stock[remaining].pop()
                if not stock[remaining]:
                    tree.set(remaining, False)
            per = remaining // size
            full = min(left // per, count)
            part = left - full * per if full < count else 0
            if full:
                placed.append((size, rank, full * per, first, per, capacity - remaining))
                put(remaining - per * size, first, full)
            if part:
                placed.append((size, rank + full * per, part, first + full, part, capacity - remaining))
                put(remaining - part * size, first + full, 1)
            put(remaining, first + full + (part > 0), count - full - (part > 0))
            left -= full * per + part
            rank += full * per + part
    return placed, bins


def placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    rows, _ = best_fit_decreasing(histogram, capacity)
    # sorted by size and rank, both in one key
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(((table[:, 0] << 44) | table[:, 1], table))
    # only frequent sizes are dealt out further: at most capacity rows say in how many parts
    salts = spark.createDataFrame([(n, 1 + k // RANKED) for n, k in histogram.items()], "length bigint, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece), salts)"))
    sizes = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    groups = sum(1 + k // RANKED for k in histogram.values())
    ranked = join_checked(salted.withColumn("own", own), sizes, ["length", "salt"], groups)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            of = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1] if len(length) else table[:0]
            i = rank - of[:, 1]
            columns = [pa.array(of[:, 3] + i // np.maximum(of[:, 4], 1)), pa.array(of[:, 5] + length * (i % np.maximum(of[:, 4], 1)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(task, PIECE + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(tokenized(docs, capacity, public_tokenizers.path(vocabulary)), "pieces")
    return placed(pieces, capacity)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """sequence_id, ids array<int>, doc_ids array<bigint>: the packed sequences themselves, for unique doc_ids.

    Each has at most ``capacity`` ids, so a group is bounded.
    """
    path = public_tokenizers.path(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tail = ids_of(path), np.array([end], "<u4").tobytes()
        for b in batches:
            doc, piece, found = [], [], []
            for doc_id, data in zip(b.column("doc_id").to_pylist(), ids.of(b.column("text").to_pylist()), strict=True):
                every = np.frombuffer(data + tail, "<u4").astype(np.int32)
                for k, at in enumerate(range(0, len(every), capacity)):
                    doc.append(doc_id), piece.append(k), found.append(every[at : at + capacity])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    cut = docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, piece int, ids array<int>")
    parts = packed.join(cut, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))
