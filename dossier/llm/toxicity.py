"""Operator 8: toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, digits and symbols
that stand for letters to those letters, everything else to single spaces.  An Aho-Corasick automaton then
finds the lexicon's words, as whole words; those inside an exception phrase do not count.  The sum of the
weights, plain and per hundred words, goes through a logistic curve.

All is learned.  A word's weight is the smoothed log-odds of toxic against other documents having it; words
in MIN_DOCS toxic documents with a weight of MIN_WEIGHT or more are the lexicon.  An exception is such a
word with a neighbour, in MIN_DOCS clean documents or more, whose own log-odds are not positive.  The curve
is fitted on rows that the lexicon has not seen.  All three use a bounded sample of labelled rows (SAMPLE
per class, picked by a hash of the id), never a row whose crc32(doc_id) mod 5 is 0.

Defined results: null and empty texts get the score of a text without a hit; a text is scored whole, in
time linear in its length; equal texts get equal scores; a null or repeated label row counts as given;
without labels of both classes every score is 0; columns of any name pass through in a struct; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dossier.llm.common import crc_of_id, read

#: Labelled rows per class that are learned from, at most (in expectation).
SAMPLE = 20_000
MIN_DOCS = 3
MIN_WEIGHT = 1.5
#: Look-alike letters of other scripts, and digits and symbols that stand for letters.
LOOK_ALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ƚ": "l", "ɑ": "a", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_table = str.maketrans({**LOOK_ALIKES, **{chr(0xFF41 + k): chr(97 + k) for k in range(26)}})
_symbols = re.compile(r"(?<=\w)[@$!|](?=\w)|[@$](?=\w)")
_digit = re.compile(r"(?<=[^\W\d])[0-9]+(?=[^\W\d])|(?<=[^\W\d])[0-9](?!\w)|(?<!\w)[0-9](?=[^\W\d])")
_other = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded words with a space before and after each."""
    text = (text or "").lower().translate(_table)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _symbols.sub(lambda m: {"@": "a", "$": "s", "!": "i", "|": "l"}[m[0]], text)
    text = _digit.sub(lambda m: "".join(DIGITS.get(c, c) for c in m[0]), text)
    return f" {_other.sub(' ', text).strip()} "


class Matcher:
    """Whole-word Aho-Corasick search with exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.automaton = ahocorasick.Automaton()
        for word, weight in lexicon.items():
            self.automaton.add_word(f" {word} ", (len(word), weight))
        for phrase in exceptions:
            if (key := fold(phrase)) not in self.automaton:
                self.automaton.add_word(key, (len(key) - 2, None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Sum of weights, the same per hundred words, words hit."""
        folded = fold(text)
        words = max(1, folded.count(" ") - 1)
        if self.empty:
            return 0.0, 0.0, 0
        hits, spared = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (spared if weight is None else hits).append((end - size, end, weight))
        if spared and hits:
            # a hit is inside a phrase if of those that begin no later one ends no earlier
            starts, ends = np.array([(a, b) for a, b, _ in sorted(spared)]).T
            far = np.maximum.accumulate(ends)
            at = np.searchsorted(starts, [a for a, _, _ in hits], "right") - 1
            hits = [h for h, k in zip(hits, at.tolist(), strict=True) if k < 0 or far[k] < h[1]]
        total = sum(w for _, _, w in hits)
        return total, 100.0 * total / words, len(hits)


@functools.lru_cache(maxsize=4)
def matcher_of(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> Matcher:
    """A worker builds the automaton once for all its tasks."""
    return Matcher(dict(lexicon), exceptions)


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method; the bias is last."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (y - p) - 0.01 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w


def shaped(total, rate, hits) -> list[float]:
    return [math.log1p(total), math.log1p(rate), math.log1p(hits)]


class Model:
    """The lexicon, the exceptions and the weights of the curve (the bias last)."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = (), weights: list[float] | None = None):
        self.lexicon, self.exceptions, self.weights = tuple(sorted(lexicon.items())), exceptions, weights or []

    def features(self, texts: list[str | None]) -> list[list[float]]:
        matcher = matcher_of(self.lexicon, self.exceptions)
        return [shaped(*matcher.features(t)) for t in texts]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.weights:
            return [0.0] * len(texts)
        z = [sum(w * v for w, v in zip(self.weights, [*row, 1.0], strict=True)) for row in self.features(texts)]
        return [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]


def phrases(words: list[str], lexicon: dict[str, float]) -> set[str]:
    """Words of the lexicon with the word before and with the word after."""
    found = set()
    for k, word in enumerate(words):
        if word in lexicon:
            found.update(" ".join(words[a : a + 2]) for a in (k - 1, k) if 0 <= a and a + 2 <= len(words))
    return found


def counted(texts: DataFrame, terms) -> DataFrame:
    """term, clean, toxic: the documents of each class (text, toxic) that have a term; terms(words) gives those of one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(terms(fold(text).split()))
        found = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([s[w] for w in found], pa.int64()) for s in seen)], ["term", "clean", "toxic"])

    return texts.select("text", "toxic").mapInArrow(task, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model; what is collected is bounded by the sample of labelled rows."""
    labels = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic", (crc_of_id(F.col("doc_id")) % 5).alias("fold")).filter("fold <> 0")
    counts = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({})
    share = F.expr(f"CASE toxic WHEN 0 THEN {min(1.0, sample / counts[0])} ELSE {min(1.0, sample / counts[1])} END")
    picked = labels.filter(F.expr("pmod(xxhash64(doc_id), 1000003) / 1000003D") < share).select("doc_id", "toxic", "fold")
    # at most about two samples of rows in expectation, so that they may go to every executor
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    known = picked.groupBy("toxic").agg(F.count_if(F.expr("fold < 4")).alias("n")).collect()
    n = {0: 0, 1: 0} | {r.toxic: r.n for r in known}
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    seen = texts.filter("fold < 4")
    words = counted(seen, set).filter(F.col("toxic") >= MIN_DOCS).withColumn("weight", weight).filter(F.col("weight") >= MIN_WEIGHT)
    lexicon = {r.term: r.weight for r in words.collect()}
    spared = counted(seen, functools.partial(phrases, lexicon=lexicon)).filter(F.col("clean") >= MIN_DOCS).filter(weight <= 0)
    model = Model(lexicon, tuple(sorted(r.term for r in spared.collect())))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = model.features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(3)] + [b.column("toxic").cast(pa.int64())], ["a", "b", "c", "toxic"])

    rows = texts.filter("fold = 4").select("text", "toxic").mapInArrow(measure, "a double, b double, c double, toxic bigint").collect()
    if len({r.toxic for r in rows}) < 2:
        model.weights = [1.0, 1.0, 1.0, -5.0]
        return model
    data = np.array([tuple(r) for r in rows], float)
    data = data[np.lexsort(data.T)]
    model.weights = curve(data[:, :3], data[:, 3]).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of the documents) and score."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.scores(b.column("row").field("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, pa.float64())], ["row", "score"])

    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).mapInArrow(task, StructType([StructField("row", docs.schema, False), StructField("score", DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score and the predicted label."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = score(docs, learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return found.select(
        "row.doc_id", (crc_of_id(F.col("row.doc_id")) % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that score under ``limit``."""
    return score(docs, learn(docs, labels)).filter(F.col("score") < limit).select("row.*")
