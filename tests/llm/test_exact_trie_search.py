"""Operators 11 to 13: brute force on rows with nulls, ties, repeats and clashing names; forced collisions, late files, small shards."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import exact_dedup, lexical_search, prefix_trie
from dossier.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_prefix_trie", "op13_lexical_search"])
def test_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01")


# exact deduplication


def groups_of(rows):
    """Per row (doc_id, text): keep_id, group size, hash; rows of None ids last."""
    plain = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    by = defaultdict(list)
    for i, t in plain:
        by[t].append(i)
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    return sorted((str(i), str(least(by[t])), len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain), len(by)


def absorbed(spark, path, folder, **more):
    exact_dedup.absorb(spark, path, folder, **more)
    found = exact_dedup.verdicts(spark, path, folder).collect()
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found), sum(r.kept for r in found)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_of_odd_rows(spark, docs, odd_docs, tmp_path, weak):
    """weak: a digest of one byte, so that texts that differ share digests and have to be told apart by their bytes."""
    path = str(tmp_path / "documents.parquet")
    docs.withColumn("file", F.lit("x")).withColumn("digest", F.lit(1)).write.parquet(path)
    more = {"digest": lambda sha: F.unhex(F.substring(sha, 1, 1))} if weak else {}
    assert absorbed(spark, path, str(tmp_path / "state"), **more) == groups_of([(r[0], r[1]) for r in odd_docs])


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    """Files that come later meet the state of those before; a smaller doc_id that comes late takes over."""
    rng, path, folder = random.Random(3), str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    rows = []
    for part in range(3):
        new = [(1000 * (3 - part) + k, rng.choice(("a b", "a  b", "c", None, "", f"only {part} {k}"))) for k in range(40)]
        rows += new
        spark.createDataFrame(new, "doc_id long, text string").repartition(2).write.mode("append").parquet(path)
        assert absorbed(spark, path, folder, files=1) == groups_of(rows)
    assert absorbed(spark, path, folder) == groups_of(rows)


def test_exact_dedup_splits_a_hot_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    monkeypatch.setattr("dossier.llm.common.HOT_ROWS", 50)
    path, rows = str(tmp_path / "documents.parquet"), [(k, "same  text" if k % 3 == 0 else f"t{k % 100}") for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    assert absorbed(spark, path, str(tmp_path / "s")) == groups_of(rows)
    assert absorbed(spark, path, str(tmp_path / "t"), digest=lambda sha: F.unhex(F.substring(sha, 1, 2))) == groups_of(rows)


def test_exact_dedup_of_nothing(spark, no_docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    no_docs.write.parquet(path)
    assert absorbed(spark, path, str(tmp_path / "state")) == ([], 0)


# prefix trie


def trie_of(rows):
    """Nodes by brute force, as dictionaries of their prefixes."""
    logs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            logs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    logs = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in logs.items()}
    built = {}
    for c, own in logs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = logs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    done = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((min(w), len(p), str(min(members[p[:-1]]) if p else None), len(w), below[p], leaves[p], saved[p], done(p)) for p, w in members.items())


def trie(spark, rows):
    log = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(3)
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), *r[3:]) for r in prefix_trie.prefix_trie(log).collect())


def test_trie_of_odd_rows(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for c in [*range(0, 130), *range(-5, 0), 4000]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice((t, t, None)), rng.choice(("user", "assistant", None)), rng.choice((None, "", "a", "a b", " a  b\n", "a b c " * 300))))
    rows += [(7, 0, "user", "a")] * 3 + [(None, 0, "user", "x"), (None, None, None, None)]
    rows += [(c, t, "user", "one two") for c in range(200, 260) for t in range(4)]  # copies
    rows += [(c, t, "user", f"long {t}") for c in (300, 320) for t in range(12)] + [(320, 12, "user", "end")]
    expected = trie_of(rows)
    assert trie(spark, rows) == expected
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr("dossier.llm.common.HOT_ROWS", 4)
    assert trie(spark, rows) == expected


def test_trie_of_one_long_conversation(spark):
    """Turns that nobody shares need no levels; runs longer than the 4,096 rows of a step are whole."""
    rows = [(20, t, "user", f"w {t}") for t in range(9_000)] + [(40, 0, "user", "w 0")]
    assert trie(spark, rows) == trie_of_chain(rows)


def trie_of_chain(rows):
    """The same by hand: both keep their own turns (their base is themselves); they share the first."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    nodes = [(20, 0, "None", 2, 1, 1, 2, sha("")), (20, 1, "20", 2, 1, 1, 2, sha("40"))]
    return nodes + [(20, d, "20", 1, int(d < 9_000), 1, 0, sha("20" if d == 9_000 else "")) for d in range(2, 9_001)]


def test_trie_without_turns(spark):
    assert trie(spark, []) == []
    lone = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)  # absent base, one turn: nothing is left
    assert trie(spark, [(lone, 0, "user", "x")]) == [(lone, 0, "None", 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert trie(spark, [(None, 0, "user", "x")]) == []


# ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(rows, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for place, (doc, c) in enumerate(counts):
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    m = 50 + 50 * c.total() * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                scores.append((-score, doc is None, doc or 0, place))
        out += [(str(item), r + 1, str(None if none else doc), -s) for r, (s, none, doc, _) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def searched(docs, items, **more):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in lexical_search.ranked(docs, items, **more).collect())


@pytest.fixture(scope="module")
def asked(odd_docs):
    rng = random.Random(4)
    some = [" ".join(rng.sample((t or "x y").split() or ["x"], min(12, len((t or "x y").split())) or 1)) for _, t, *_ in odd_docs[::7]]
    return [*enumerate(some), (50, "the THE of The"), (50, "ñandú É é"), (51, None), (52, ""), (None, "the end of it"), (53, "!! ??"), (54, "unseen")]


@pytest.mark.parametrize("small", [False, True])
def test_search_of_odd_rows(spark, docs, odd_docs, asked, monkeypatch, small):
    if small:
        for name, value in (("DOCS_PER_SHARD", 9), ("WIDE", 2), ("SLICE", 40), ("BLOCK_CHARS", 300)):
            monkeypatch.setattr(lexical_search, name, value)
    items = spark.createDataFrame([(i, t, 3) for i, t in asked], "item_id long, text string, rank int")
    expected = ranking([(r[0], r[1]) for r in odd_docs], asked)
    assert searched(docs, items) == expected
    assert searched(docs, items, k=3) == ranking([(r[0], r[1]) for r in odd_docs], asked, 3)


def test_search_among_many_ties(spark):
    """Copies of one text tie: the smallest ids win, whichever shard they are in."""
    rows = [(k * 7 % 400, "alpha beta" if k % 2 else f"alpha gamma{k % 5}") for k in range(400)] + [(None, "alpha beta")] * 60
    frame, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), [(1, "beta"), (2, "alpha gamma1"), (3, "alpha")]
    assert searched(frame, spark.createDataFrame(items, "item_id long, text string")) == ranking(rows, items)


def test_search_of_nothing(spark, no_docs, docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert searched(no_docs, items) == [] and searched(docs, items.filter("false")) == []


def test_wavelet_tree_orders():
    """Each level keeps the order by term and falling impact; a document's leaf has its impacts."""
    rng = np.random.default_rng(2)
    term, doc = np.divmod(rng.choice(40 * 100, 900, replace=False), 100)
    impact = rng.integers(1, 1000, 900)
    tree = lexical_search.WaveletTree(term, doc, impact, 100, 40)
    weights, asked = rng.integers(1, 50, 40), np.arange(0, 40, 2)
    scores = np.zeros(100, np.int64)
    even = term % 2 == 0
    np.add.at(scores, doc[even], impact[even] * weights[term[even]])
    best = np.lexsort((np.arange(100), -scores))[:20]
    best = best[scores[best] > 0]
    docs, found = tree.top(asked, weights[asked], 20)
    assert docs.tolist() == best.tolist() and found.tolist() == scores[best].tolist()
