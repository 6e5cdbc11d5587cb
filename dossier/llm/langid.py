"""Operator 3: language identification by interpolated Kneser-Ney character models.

Words are read as letters between boundaries, in lower case; a character's context is the up to three
characters before it in its word, boundary included.  For each language all four-grams of its training
sample are counted (in each task first, then by Spark), none is pruned; lower orders are continuation counts of the
order above, with absolute discounting and interpolation down to a uniform distribution.  The models of
all languages stand side by side in arrays sorted by the hash of the n-gram, so one binary search gives
the log-probabilities in every language; what no language has seen falls back by context weights.

The language with the lowest cross-entropy per character wins.  On training documents that were not
counted, the spread of the others is turned to a probability (a logistic scale, fitted), and a quantile
of each language's own cross-entropy becomes its limit of rejection.

Bounds: TRAINED documents a language to count and CALIBRATION documents to calibrate on, both in expectation,
picked by a hash of the id among the labelled rows outside the held-out quarter.  The model holds every
n-gram of those documents, so its size is bounded by them and by the number of languages.

Defined results: null texts and texts without a letter are ``und`` with score 0, not accepted; without
training rows every text is; ties go to the language first in order; repeated rows are judged one by one;
very long texts are read in slices; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import crc_of_id, join_checked, read
from dossier.llm.spans import mix

ORDER = 4
TRAINED = 6_000
CALIBRATION = 4_000
REJECT = 0.999
#: Characters handled at once.
SLICE = 1 << 19
U = np.uint64
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Symbol of each code point: itself if a letter (65535 beyond the BMP), 0 if not."""
    if not _letters:
        table = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)
        _letters.append(np.minimum(table, 0xFFFF).astype(np.uint64))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-grams (16 bits a symbol, 0 before a word) of the texts, and the text each is from."""
    sizes = np.array([len(t) + 1 for t in texts])
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    c0 = letters()[code]
    c1, c2, c3 = (np.r_[np.zeros(k, np.uint64), c0][: len(c0)] for k in (1, 2, 3))
    c2 = np.where(c1 == 0, U(0), c2)
    c3 = np.where(c2 == 0, U(0), c3)
    keep = np.flatnonzero((c0 != 0) | (c1 != 0))
    return (c3[keep] << U(48)) | (c2[keep] << U(32)) | (c1[keep] << U(16)) | c0[keep], np.searchsorted(np.cumsum(sizes), keep, "right")


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[str], bool]]:
    """First row, texts and whether the row goes on: rows together up to SLICE characters, long ones in parts cut at white space."""
    first, some, size = 0, [], 0
    for k, text in enumerate(texts):
        text = (text or "").lower()
        if len(text) > SLICE:
            if some:
                yield first, some, False
            at = 0
            while at < len(text):
                end = min(len(text), at + SLICE)
                while end < len(text) and text[end - 1].isalpha():
                    end += 1
                yield k, [text[at:end]], True
                at = end
            first, some, size = k + 1, [], 0
            continue
        some.append(text)
        size += len(text)
        if size > SLICE:
            yield first, some, False
            first, some, size = k + 1, [], 0
    if some:
        yield first, some, False


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[cut], np.add.reduceat(counts, cut)


def counted(docs: DataFrame) -> DataFrame:
    """lang, key, count of the four-grams of all given documents (lang, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs):
                for _, texts, _ in groups([t for t, own in zip(b.column("text").to_pylist(), langs == lang, strict=True) if own]):
                    keys, counts = np.unique(grams(texts)[0], return_counts=True)
                    found[lang][0].append(keys), found[lang][1].append(counts)
                if len(found[lang][0]) > 16:
                    keys, counts = merged(*found[lang])
                    found[lang] = [keys], [counts]
        for lang, parts in found.items():
            if parts[0]:
                keys, counts = merged(*parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "key", "count"])

    return docs.select("lang", "text").mapInArrow(task, "lang string, key bigint, count bigint").groupBy("lang", "key").agg(F.sum("count").alias("count"))


def find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the values are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


class KneserNey:
    """One language's model over packed n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, symbols: int):
        self.levels, self.uniform = {}, 1.0 / symbols
        for k in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones and twos else 0.5
            contexts, start = np.unique(keys >> U(16), return_index=True)
            total, kinds = np.add.reduceat(counts, start).astype(float), np.diff(np.r_[start, len(keys)])
            self.levels[k] = keys, counts, contexts, total, discount * kinds / total, discount
            # how many different symbols stand before each shorter n-gram
            keys, counts = np.unique(keys & U((1 << 16 * (k - 1)) - 1), return_counts=True)

    def probability(self, k: int, asked: np.ndarray) -> np.ndarray:
        if k == 0:
            return np.full(len(asked), self.uniform)
        keys, counts, contexts, total, back, discount = self.levels[k]
        lower = self.probability(k - 1, asked & U((1 << 16 * (k - 1)) - 1))
        at, seen = find(contexts, asked >> U(16))
        own, there = find(keys, asked)
        count = np.where(there, np.maximum(counts[own] - discount, 0.0), 0.0)
        return np.where(seen, count / total[at] + back[at] * lower, lower)

    def backoff(self, k: int, contexts: np.ndarray) -> np.ndarray:
        at, seen = find(self.levels[k][2], contexts)
        return np.where(seen, self.levels[k][4][at], 1.0)


class Models:
    """All languages side by side in sorted hash arrays: per order, n-grams and their contexts."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = [lang for lang, _, _ in rows]
        symbols = 1 + len(np.unique(np.concatenate([keys & U(0xFFFF) for _, keys, _ in rows])))
        models = [KneserNey(keys, counts, symbols) for _, keys, counts in rows]
        self.uniform = np.log(1.0 / symbols)
        self.tables = {}
        for k in range(ORDER, 0, -1):
            sides = []
            for part, value in ((0, lambda m, x: m.probability(k, x)), (2, lambda m, x: m.backoff(k, x))):  # noqa: B023
                keys = np.unique(np.concatenate([m.levels[k][part] for m in models]))
                hashes = mix(keys)
                order = np.argsort(hashes)
                values = np.stack([np.log(value(m, keys)) for m in models], 1).astype(np.float32)
                sides.append((hashes[order], values[order]))
            self.tables[k] = sides

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram's last symbol in each language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            (hashes, values), (contexts, weights) = self.tables[k]
            at, seen = find(hashes, mix(keys))
            if k == ORDER and seen.all():
                return values[at]
            out[left[seen]] += values[at[seen]]
            left, keys = left[~seen], keys[~seen]
            at, seen = find(contexts, mix(keys >> U(16)))
            out[left[seen]] += weights[at[seen]]
            keys = keys & U((1 << 16 * (k - 1)) - 1)
        out[left] += np.float32(self.uniform)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and its characters (0: no letter)."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for first, some, _ in groups(texts):
            keys, row = grams(some)
            if not len(keys):
                continue
            cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[first + row[cut]] -= np.add.reduceat(self.scores(keys), cut, axis=0, dtype=np.float64)
            n[first + row[cut]] += np.diff(np.r_[cut, len(row)])
        return total / np.maximum(n, 1)[:, None], n


def fit(docs: DataFrame, trained: int = TRAINED, calibration: int = CALIBRATION) -> tuple[Models | None, float, list[float]]:
    """Models, the logistic scale and each language's limit, from (doc_id, lang, text) rows outside the held-out quarter."""
    docs = docs.filter("lang is not null").withColumn("fold", crc_of_id(F.col("doc_id")) % 4).filter("fold <> 2")
    drawn = F.expr("pmod(xxhash64(doc_id), 1000003) / 1000003D")
    known = docs.filter("fold <> 3").groupBy("lang").count()
    sample = join_checked(docs.filter("fold <> 3"), known, ["lang"], known.count()).filter(drawn < F.lit(trained) / F.col("count"))
    rows = counted(sample).toArrow()
    if not rows.num_rows:
        return None, 1.0, []
    lang = np.array(rows.column("lang").to_pylist(), object)
    key, count = rows.column("key").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    parts = []
    for name in sorted(set(lang)):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(key[own])]
        parts.append((name, key[own], count[own]))
    models = Models(parts)
    rest = docs.filter("fold = 3")
    share = min(1.0, calibration / max(1, rest.count()))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each, n = shared.value.entropies(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(list(each), pa.list_(pa.float64())), pa.array(n)], ["lang", "each", "n"])

    some = rest.filter(drawn < share).select("lang", "text")
    found = [r for r in some.mapInArrow(task, "lang string, each array<double>, n bigint").collect() if r.n and r.lang in models.langs]
    if not found:
        return models, 1.0, [float("inf")] * len(parts)
    each, true = np.array([r.each for r in found]), np.array([models.langs.index(r.lang) for r in found])
    gap = each - each.min(1, keepdims=True)
    scales = np.exp(np.linspace(0, 8, 81))
    loss = [np.mean(np.minimum(gap[np.arange(len(true)), true] * s, 30) + np.log(np.exp(-gap * s).sum(1))) for s in scales]
    limits = [float(np.quantile(each[true == k, k], REJECT)) if (true == k).any() else float("inf") for k in range(len(parts))]
    return models, float(scales[int(np.argmin(loss))]), limits


def identify(docs: DataFrame, models: Models | None, scale: float, limits: list[float]) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((models, scale, limits))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, scale, limits = shared.value
        for b in batches:
            rows = b.num_rows
            pred, score, accepted = ["und"] * rows, np.zeros(rows), np.zeros(rows, bool)
            if models is not None and rows:
                each, n = models.entropies(b.column("text").to_pylist())
                best = each.argmin(1)
                least = each[np.arange(rows), best]
                score = np.where(n > 0, 1 / np.exp(-(each - least[:, None]) * scale).sum(1), 0.0)
                accepted = (n > 0) & (least <= np.array(limits)[best])
                pred = [models.langs[k] if m else "und" for k, m in zip(best, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(task, "doc_id bigint, lang_pred string, score double, accepted boolean")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, the predicted language, its probability and whether it is accepted."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, *fit(docs))
    return found.select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "accepted")
