"""Near copies by exact similarity of word shingles: what follows the fingerprints in the pipeline.

Two texts are near copies if the Jaccard similarity of their multisets of SHINGLE-word shingles is
SIMILARITY or more (the k-th occurrence of a shingle is an element of its own, so a text that repeats
itself at length is no copy of one that does not).  Equal multisets are one node.  Candidates share one of
BANDS keys of ROWS min-hashes each: a pair at 0.8 is missed with probability (1 - 0.8 ** 5) ** 24
= 0.00007 by calculation, one at 0.9 practically never.  Every link is verified on the shingles themselves: first each
node of a bucket against the bucket's least node, then what is still in different components: the pairs of
buckets of up to SMALL nodes, and in larger ones the nodes outside of the largest component against all, in pairs of
blocks that are dealt out over the tasks.

Defined results: lower-casing touches A-Z only; fewer words than a shingle give one shingle of them all;
texts without words are copies of each other and of nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import NO_ID, Scratch, connected_components, join_checked, join_facts

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Nodes up to which a bucket's pairs are joined, and nodes of larger buckets in a block.
SMALL = 32
BLOCK = 4_096
#: Shingles of stragglers that one task holds, and nodes that meet one copy of a leader's shingles.
ASKING, SALT = 1_000_000, 2_000
U = np.uint64
_rng = np.random.default_rng(17)
_factors = _rng.integers(0, 2**63, BANDS * ROWS, dtype=U) * U(2) + U(1)
_shifts = _rng.integers(0, 2**63, BANDS * ROWS, dtype=U)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles of a text, each occurrence with one of its own."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U)
    joined = b" ".join(words)
    if len(words) <= size:
        found = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashed = xxhash.xxh64_intdigest
        found = [hashed(joined[a : b - 1], 42) for a, b in zip(starts, starts[size:], strict=False)]
    keys, counts = np.unique(np.array(found, U), return_counts=True)
    if len(keys) == len(found):
        return keys
    again = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(np.repeat(keys, counts) + again.astype(U) * U(0x9E3779B97F4A7C15))


def band_keys(elements: np.ndarray) -> list[int]:
    """The keys under which a text is a candidate: none for a text without words."""
    if not len(elements):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, U)
    for at in range(0, len(elements), 2048):
        np.minimum(least, (_factors[:, None] * elements[None, at : at + 2048] + _shifts[:, None]).min(axis=1), out=least)
    data, width = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(data[k * width : (k + 1) * width], k) - 2**63 for k in range(BANDS)]


def identified(docs: DataFrame) -> DataFrame:
    """id (null as the largest), two hashes h, g of the text, text, and row: all columns, whose names so cannot clash with ours."""
    text = docs["text"].cast("string")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    return docs.select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"), row)


def marked(docs: DataFrame, shingle: int, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """id, h, g, node, fp, keys of every row; fp is the fingerprint of its shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, keys = [], [], []
            for text in b.column("text").to_pylist():
                elements = shingles(text, shingle)
                nodes.append(xxhash.xxh64_intdigest(elements.tobytes(), 7) - 2**63)
                fps.append(fingerprint(elements))
                keys.append(band_keys(elements))
            own = [b.column(c) for c in ("id", "h", "g")]
            found = [pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, *found], ["id", "h", "g", "node", "fp", "keys"])

    thin = identified(docs).select("id", "h", "g", "text")
    return thin.mapInArrow(task, "id bigint, h bigint, g bigint, node bigint, fp bigint, keys array<bigint>")


def shingled(texts: DataFrame, shingle: int) -> DataFrame:
    """node, own: the shingles of each node's text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t, shingle).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    return texts.mapInArrow(task, "node bigint, own array<bigint>")


def verified(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is reached.

    One a may have very many b: its shingles are copied to a salt for every SALT of them.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / SALT).cast("int")
    salted = join_facts(pairs, sizes, ["a"], "n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    x = own.select(F.col("node").alias("a"), F.col("own").alias("x")).join(sizes, "a").select("a", "x", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = salted.join(own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").join(x, ["a", "salt"])
    m, n = F.size("x"), F.size("y")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(F.least(m, n) >= similarity * F.greatest(m, n)).filter(shared / (m + n - shared) >= similarity).select("a", "b")


def alike(asking: list[np.ndarray], similarity: float):
    """A function that tells which of the shingle arrays ``asking`` are alike to another one."""
    sizes = np.array([len(a) for a in asking])
    every = np.concatenate(asking)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(asking)), sizes)[order]

    def ask(other: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(every, other, "left"), np.searchsorted(every, other, "right")
        some = high > low
        low, count = low[some], (high - low)[some]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        shared = np.bincount(owner[at], minlength=len(asking))
        return np.flatnonzero(shared >= similarity * (sizes + len(other) - shared))

    return ask


def found_by_stragglers(buckets: DataFrame, own: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components within large buckets (key, node, component).

    Buckets that share nodes make a family, so that a node's shingles are sent once and not for each of its keys.
    Two nodes of different components are not both in a family's largest one, so it is enough to ask with those
    outside of it.  A family's stragglers are dealt to blocks of ASKING shingles, all its nodes to blocks of BLOCK,
    and each pair of blocks is a group of its own: its task holds the block of stragglers and streams the nodes.
    It writes one link for a straggler and a component at most.
    """
    families = connected_components(buckets.select(F.col("node").alias("a"), F.col("key").alias("b")), Scratch(buckets.sparkSession))
    members = buckets.select("node", "component").distinct().join(families.select("node", F.col("component").alias("family")), "node")
    parts = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("size"))
    rows = members.join(parts, "family").join(own, "node").withColumn("asks", F.col("component") != F.col("largest"))
    rows = scratch.write(rows.select("family", "node", "component", "own", "asks", "size"), "large-buckets")
    work = F.sum(F.when(F.col("asks"), F.size("own"))).alias("work")
    blocks = rows.groupBy("family").agg(work, F.first("size").alias("all"))
    blocks = blocks.select("family", F.ceil(F.col("work") / ASKING).cast("int").alias("askers"), F.ceil(F.col("all") / BLOCK).cast("int").alias("askeds"))
    rows = rows.join(blocks, "family")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asking = rows.filter("asks").withColumn("x", dealt("askers")).withColumn("y", every("askeds")).withColumn("role", F.lit(0))
    asked = rows.withColumn("x", every("askers")).withColumn("y", dealt("askeds")).withColumn("role", F.lit(1))
    group = ["family", "x", "y"]
    met = asking.unionByName(asked).select(*group, "role", "node", "component", "own").repartition(*group).sortWithinPartitions(*group, "role")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, parts, asking, ask, done = None, [], [], [], None, set()
        for b in batches:
            pairs = []
            places = zip(*(b.column(c).to_pylist() for c in (*group, "role", "node", "component")), strict=True)
            for (family, x, y, role, node, component), shingle_list in zip(places, b.column("own"), strict=True):
                if at != (family, x, y):
                    at, nodes, parts, asking, ask, done = (family, x, y), [], [], [], None, set()
                mine = shingle_list.values.to_numpy()
                if role == 0:
                    nodes.append(node)
                    parts.append(component)
                    asking.append(mine.copy())
                elif asking:
                    ask = ask or alike(asking, similarity)
                    for j in ask(mine).tolist():
                        if parts[j] != component and (j, component) not in done:
                            done.add((j, component))
                            pairs.append((min(node, nodes[j]), max(node, nodes[j])))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return met.mapInArrow(task, "a bigint, b bigint").distinct()


def bucketed(bands: DataFrame) -> DataFrame:
    """Those of the rows (node, key, each once) whose key has several nodes, with the least of these as leader."""
    shared = bands.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").select("key", "leader")
    return bands.join(shared, "key").select("key", "node", "leader")


def stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's leader and its other nodes."""
    return buckets.filter("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def components(docs: DataFrame, marks: DataFrame, classes: DataFrame, scratch: Scratch, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id, h, g, component of every row: rows of one component are linked by near copies.

    marks: ``marked`` of the documents; classes: node, key of the first candidates, each node once.
    """
    near = scratch.write(bucketed(classes), "near")
    buckets = scratch.write(bucketed(marks.select("node", F.explode("keys").alias("key")).distinct()), "buckets")
    nodes = scratch.write(near.select("node").unionAll(buckets.select("node")).distinct(), "nodes")
    some = marks.join(nodes, "node").groupBy("node").agg(F.min(F.struct("id", "h", "g")).alias("row")).select("node", "row.*")
    some = scratch.write(some, "some")
    rows = some.count()
    texts = join_checked(identified(docs).select("id", "h", "g", "text"), some, ["id", "h", "g"], rows)
    own = scratch.write(shingled(texts.select("node", "text"), shingle), "own")
    if own.count() > rows:  # rows that are equal in id and text
        own = scratch.write(own.dropDuplicates(["node"]), "own-once")
    tried = scratch.write(stars(near), "near-stars")
    links = scratch.write(verified(tried, own, similarity), "near-links")
    placed = scratch.write(connected_components(links, Scratch(docs.sparkSession)), "near-components")
    # min-hash buckets only compare what the classes left apart
    n, more = placed.count(), stars(buckets)
    for end in "ab":
        of = placed.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        more = join_checked(more, of, [end], n, "left")
    more = scratch.write(more.filter("of_a is null or of_b is null or of_a <> of_b").select("a", "b"), "stars")
    links = scratch.write(links.unionAll(verified(more, own, similarity)), "star-links")
    placed = scratch.write(connected_components(links, scratch), "star-components")
    tried, buckets = tried.unionAll(more), near.unionAll(buckets)
    # what the stars left apart: buckets of more than one component
    buckets = buckets.select("key", "node").join(placed, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    sizes = buckets.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    buckets = scratch.write(buckets.join(sizes.filter("low < high").select("key", "size"), "key"), "apart")
    few = buckets.filter(F.col("size") <= SMALL)
    x, y = (few.select("key", F.col("node").alias(n), F.col("component").alias(f"of_{n}")) for n in "ab")
    rest = x.join(y, "key").filter("a < b and of_a <> of_b").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    rest = scratch.write(rest, "rest")
    more = scratch.write(verified(rest, own, similarity).unionAll(found_by_stragglers(buckets.filter(F.col("size") > SMALL), own, similarity, scratch)), "more-links")
    if more.limit(1).count():
        placed = connected_components(links.unionAll(more), Scratch(docs.sparkSession))
    found = marks.select("id", "h", "g", "node").join(placed, "node", "left")
    return scratch.write(found.select("id", "h", "g", F.coalesce("component", "node").alias("component")), "components")
