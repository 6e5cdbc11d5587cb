"""Operators 6 and 7 against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import embedding_dedup, near_copies, simhash
from dossier.llm.common import Scratch, connected_components

FAR = 2**63 - 1


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    lower = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, docs, odd_docs, monkeypatch):
    monkeypatch.setattr(simhash, "AIM", 4)  # many shards
    monkeypatch.setattr(simhash, "SHARD", 3)  # split into blocks
    rows = [(FAR if i is None else i, plain_fingerprint(t)) for i, t, *_ in odd_docs]
    links = [(a, b) for a, (_, x) in enumerate(rows) for b, (_, y) in enumerate(rows) if (x ^ y).bit_count() <= 2]
    root = components(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], FAR))
    got = sorted((FAR if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1), FAR if r.component_id is None else r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((i, f, least[root[k]]) for k, (i, f) in enumerate(rows))


def test_upper_case_beyond_ascii_stays():
    assert simhash.fingerprint("É A") & (2**64 - 1) == plain_fingerprint("É A") != plain_fingerprint("é a")


def test_vantage_points_find_all_random_pairs():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = fps[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64))
    fps = np.unique(np.r_[fps, near])
    label = simhash.linked(fps, np.arange(len(fps)), np.arange(len(fps)), 2)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert np.array_equal(label, simhash.hook(np.arange(len(fps)), i, j))
    # every pair meets in a shard
    tree = simhash.grown(fps[:400], 5)
    home, who, shard = simhash.routed(fps, tree, 5, 2)
    visits = set(zip(who.tolist(), shard.tolist(), strict=True))
    assert all(home[a] == home[b] or (a, home[b]) in visits or (b, home[a]) in visits for a, b in zip(i, j, strict=True))


def test_one_document_of_each_group_stays(spark, docs):
    kept = simhash.keep_first(docs)
    found = simhash.near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == found.select("component_id").distinct().count()


def test_columns_of_any_name_and_type_pass(spark, docs):
    odd = docs.withColumns({"__kept": F.lit(1), "__row": F.lit("r"), "id": F.lit(2), "h": F.lit(3), "row": F.lit(4), "component": F.lit(5), "m": F.create_map(F.lit("a"), F.lit(1))})
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == simhash.keep_first(docs).count()


def planted_copies(seed=4, bases=40):
    """Rows (id, text) of random texts and of copies with more and more edited words, and their word lists."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((100 * k, " ".join(base)))
        for edits in range(1, 13):
            copy = list(base)
            for at in rng.choice(300, edits, replace=False):
                copy[at] = f"new{rng.integers(1 << 30)}"
            rows.append((100 * k + edits, " ".join(copy)))
    return rows


@pytest.mark.parametrize("small", [32, 1])
def test_near_copies_go_up_to_the_similarity(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL", small)  # 1: every bucket is a large one
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rows = planted_copies()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    root = components(range(len(rows)), links)
    expected = {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root.values())}
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == expected
    assert all(i % 100 == 0 or i % 100 > 5 for i in expected) and any(i % 100 > 6 for i in expected)


def test_fingerprints_link_before_bands(spark):
    """Without any min-hash key, copies whose fingerprints op7's trees link are still found, and only if they are alike."""
    rows = [(i, t) for i, t in planted_copies(bases=30) if i % 100 < 4] + [(9001, "a"), (9002, None), (9003, ""), (9004, "A")]
    df, scratch = spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)
    marks = scratch.write(near_copies.marked(df, 5, simhash.fingerprint_of), "marks")
    classes = scratch.write(simhash.fingerprint_classes(marks, 2, Scratch(spark)), "classes")
    fps = {r.node: r.fp for r in marks.collect() if r["keys"]}
    links = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2]
    root = components(sorted(fps), links)
    keys = {r.node: r.key for r in classes.collect()}
    assert len(keys) == len(fps) and len(links) > 10
    assert all((keys[a] == keys[b]) == (root[a] == root[b]) for a in fps for b in fps)
    bare = marks.withColumn("keys", F.array().cast("array<bigint>"))
    found = {r.id: r.component for r in near_copies.components(df, bare, classes, scratch).collect()}
    node = {r.id: r.node for r in marks.collect()}
    alike = {(a, b) for a, b in links}
    assert all(found[x] == found[y] for x in node for y in node if (node[x], node[y]) in alike and x // 100 == y // 100)
    assert all(x // 100 == y // 100 or {x, y} in ({9001, 9004}, {9002, 9003}) for x in node for y in node if found[x] == found[y])


def test_band_keys_find_pairs_at_the_similarity():
    rng = np.random.default_rng(6)
    found = 0
    for _ in range(2000):
        shared = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.unique(np.r_[shared, rng.integers(0, 2**63, 20, dtype=np.uint64)]) for _ in range(2))  # 160 of 200
        found += any(x == y for x, y in zip(near_copies.band_keys(a), near_copies.band_keys(b), strict=True))
    assert found >= 1996


def test_repeats_make_no_copy():
    once, often = near_copies.shingles("a b c d e f g h"), near_copies.shingles("a b c d e f g h " + "x " * 500)
    assert len(often) == 504 and len(np.intersect1d(once, often)) == 4


def test_documents_that_share_an_id_stay(spark, docs):
    base = " ".join(f"b{k}" for k in range(100))
    rows = [(4, base), (140, base + " tail"), (140, "a text of its own " * 9), (None, "one without an id"), (None, "another without an id, longer"), (None, "another without an id, longer")]
    rows += [(7, base.replace("b", "c")), (7, base.replace("b", "c") + " tail"), (None, None), (None, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[k] for k in (0, 2, 3, 4, 6, 8)], kept.schema).collect()))
    # the fixture's id 140: a copy of document 4 goes, the text of its own stays; so does the row without an id
    ids = [(r.doc_id, r.source) for r in simhash.keep_first(docs).collect()]
    assert (140, "s5") in ids and (140, "s0") not in ids and (None, "s4") in ids


def test_empty_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark)).collect()}
    assert got == {n: c for n, c in components({x for e in links for x in e}, links).items() if n != 200}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    rows = [(k, (base[k % 60] + (rng.normal(size=8) * 0.05 if k >= 60 else 0)).astype(np.float32).tolist(), k % 3) for k in range(240)]
    rows += [(1000 + k, rows[5][1], 2) for k in range(30)] + [(1100 + k, [2 * x for x in rows[5][1]], 2) for k in range(3)]
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [1.0, None] + [0.0] * 6, 1), (2003, [float("nan")] * 8, 1), (2004, rows[5][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [1.0, 2.0], 1)]
    rows += [(3000 + k, rng.normal(size=3).astype(np.float32).tolist(), 1) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, pivots_per_root=1).collect()}
    fair = [(i, np.array(v, float), c) for i, v, c in rows if c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a, x, c in fair for b, y, d in fair if a != b and c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    expected, count = components({r[0] for r in rows}, links), {r[0]: 0 for r in rows}
    for a, _ in links:
        count[a] += 1
    assert sum(n for n, _ in got.values()) >= 0.9 * len(links)  # recall
    assert all(got[i][0] <= count[i] for i in count)  # nothing below the threshold
    assert sum(got[i] != (count[i], expected[i]) for i in count) <= 0.1 * len(count)
    assert got[2000] == (0, 2000) and got[2004] == (0, 2004)
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0
