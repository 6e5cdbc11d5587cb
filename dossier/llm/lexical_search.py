r"""Operator 13: ranked lexical search in dual-sorted wavelet trees.

Documents are dealt to shards of bounded size.  A shard's sequence holds, term after term, the documents of the term by
falling impact; a wavelet tree over that sequence halves the range of documents at each level and keeps the order, so
the same postings can be entered by impact (the first of a range is its best) and by document (descend to its leaf).
A query is a range of the sequence for each of its terms.  At a node the best impacts of its ranges, times the weights
of the terms, add up to a bound for every document below, and at a leaf to the score.  Nodes are opened in falling
order of their bounds, WIDE at a time; those whose bound cannot reach the k-th result so far are dropped, equal bounds
only if all their documents come after it.  So the k results of a shard are exact, and the best k of all shards are the
answer.

Weights and impacts are integers: with N documents that have a term, L terms in them, n terms in a document and df
documents of a term, a term weighs floor(1000 ln((2N + 2) / (2df + 1))), and tf occurrences have the impact
10^9 tf div (1000 tf + 20 m), where m = 50 + (50 n N) div L.

Queries are answered in blocks of BLOCK_CHARS characters; only terms that a block asks for are indexed.  Counts are of
all documents.

Defined results: null and empty texts, of documents and queries, have no terms; a row of ``items`` is a query of its
own, whatever its id; rows of documents with one id are documents of their own; a null doc_id counts as the largest;
very long texts are read whole, in slices; other columns, whatever their names, are ignored; without documents or
queries there are no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import NO_ID, Scratch, read

DOCS_PER_SHARD, POSTINGS_PER_SHARD = 8_192, 2_000_000
BLOCK_CHARS = 4_000_000
SLICE = 1 << 22
WIDE = 128
#: Bytes of terms: digits, letters (A-Z lower-cased) and all of characters beyond ASCII; the others separate.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
COUNTS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
FOUND = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def term_counts(text: str | None) -> Counter:
    """How often each term (as bytes) occurs in a text."""
    plain, found, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


class WaveletTree:
    """Postings of a shard: a wavelet tree over documents, in an order by term and falling impact.

    ``ones[l][i]`` counts ones before i in the bits of level l, ``best[l]`` has the impacts in the order of level l.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        order = np.lexsort((doc, -impact, term))
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))
        self.levels = max(1, int(docs - 1).bit_length())
        sequence, impact = doc[order].astype(np.int32), impact[order].astype(np.int32)
        self.ones = np.zeros((self.levels, len(sequence) + 1), np.int32)
        self.zeros = np.zeros(self.levels, np.int32)
        self.best = np.zeros((self.levels + 1, len(sequence)), np.int32)
        self.best[0] = impact
        for level in range(self.levels):
            bit = (sequence >> (self.levels - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = len(sequence) - self.ones[level, -1]
            stable = np.argsort(bit, kind="stable")
            sequence, impact = sequence[stable], impact[stable]
            self.best[level + 1] = impact

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (places in the shard, scores above 0), best first, equal scores by place."""
        low, high = self.starts[terms], self.starts[terms + 1]
        some = (high > low) & (weights > 0)
        low, high, weights = low[some][None, :], high[some][None, :], weights[some]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(weights):
            return docs, scores
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (self.best[0][low[0]].astype(np.int64) * weights).sum()[None]
        while len(bound):
            pick = np.argpartition(-bound, WIDE)[:WIDE] if len(bound) > WIDE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            at, row = level[pick], level[pick][:, None]
            l1, h1 = self.ones[row, low[pick]], self.ones[row, high[pick]]
            zeros = self.zeros[row]
            lows = np.concatenate([low[pick] - l1, zeros + l1])
            highs = np.concatenate([high[pick] - h1, zeros + h1])
            levels, prefixes = np.concatenate([at, at]) + 1, np.concatenate([prefix[pick] * 2, prefix[pick] * 2 + 1])
            filled = highs > lows
            impacts = self.best[levels[:, None], np.where(filled, lows, 0)].astype(np.int64)
            bounds = (np.where(filled, impacts, 0) * weights).sum(axis=1)
            leaf = (levels == self.levels) & (bounds > 0)
            if leaf.any():
                docs, scores = np.concatenate([docs, prefixes[leaf]]), np.concatenate([scores, bounds[leaf]])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
            inner = (levels < self.levels) & (bounds > 0)
            bound, level, prefix = (np.concatenate([old[rest], new[inner]]) for old, new in ((bound, bounds), (level, levels), (prefix, prefixes)))
            low, high = np.concatenate([low[rest], lows[inner]]), np.concatenate([high[rest], highs[inner]])
            if len(docs) == k:
                first = prefix << (self.levels - level)  # the least document below a node
                keep = (bound > scores[-1]) | ((bound == scores[-1]) & (first < docs[-1]))
                bound, level, prefix, low, high = bound[keep], level[keep], prefix[keep], low[keep], high[keep]
        return docs, scores


def count_terms(documents: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """doc_id, place (any number), n, and the asked terms with their occurrences, of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() * 7_919
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = term_counts(text.as_py())
                known = sorted((asked[t], c) for t, c in counts.items() if t in asked)
                rows.append((doc_id, place, counts.total(), [t for t, _ in known], [c for _, c in known]))
                place += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)

    chosen = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(count, "doc_id bigint, place bigint, n bigint, terms array<int>, tfs array<int>")


def search_shards(counts: DataFrame, shards: int, queries: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best documents of each shard for each query: query, item_id, doc_id, score."""

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
        by_id = np.argsort(ids, kind="stable")
        table = table.take(pa.array(by_id))
        m = 50 + 50 * table.column("n").to_numpy() * n_docs // n_terms
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        doc = np.repeat(np.arange(len(by_id)), terms.value_lengths().to_numpy())
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        tree = WaveletTree(term, doc, 1_000_000_000 * tf // (1000 * tf + 20 * m[doc]), len(by_id), len(weights))
        names = table.column("doc_id").combine_chunks()
        found = []
        for q, (item_id, asked) in enumerate(queries):
            docs, scores = tree.top(asked, weights[asked], k)
            found.append(pa.table([pa.array(np.full(len(docs), q)), pa.array([item_id] * len(docs), pa.int64()), names.take(pa.array(docs)), pa.array(scores)], schema=FOUND))
        return pa.concat_tables(found)

    dealt = counts.filter("size(terms) > 0").select(F.pmod("place", F.lit(shards)).alias("shard"), "doc_id", "n", "terms", "tfs")
    return dealt.groupBy("shard").applyInArrow(search, "query bigint, item_id bigint, doc_id bigint, score bigint")


def ranked(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    chars, found = items.agg(F.sum(F.length("text"))).first()[0] or 0, []
    blocks = -(-chars // BLOCK_CHARS)
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        texts = [(r["item_id"], sorted(term_counts(r["text"]))) for r in block]
        asked = {t: i for i, t in enumerate(sorted({t for _, terms in texts for t in terms}))}
        if not asked:
            continue
        counts = scratch.write(count_terms(documents, asked), f"counts-{b}")
        seen = counts.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
        if not seen["postings"]:
            continue
        df = np.zeros(len(asked), np.int64)
        for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one row an asked term
            df[row["term"]] = row["count"]
        weights = np.floor(1000 * np.log((2 * seen["docs"] + 2) / (2 * df + 1))).astype(np.int64)
        queries = [(item_id, np.array([asked[t] for t in terms], np.int64)) for item_id, terms in texts]
        shards = max(-(-seen["docs"] // DOCS_PER_SHARD), -(-seen["postings"] // POSTINGS_PER_SHARD))
        best = search_shards(counts, shards, queries, weights, seen["docs"], seen["terms"], k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
f AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
i AS (
  SELECT DISTINCT q, item_id, term FROM (SELECT row_number() OVER () AS q, item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
r AS (
  SELECT q, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term), s GROUP BY q, item_id, k, doc_id
), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50
"""
