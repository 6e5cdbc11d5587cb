"""The exact similarity join against the ratio of all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions.text import squash
from dossier.operators import similar
from dossier.operators.similar import Segments, near_pairs
from dossier.plans.documents import near_dup_pairs

PAGES = "group string, page long, body string"


def all_pairs(rows, least=0.95, shortest=40):
    """(group, a, b) by comparing all pages of a group; counts of characters bound the ratio from above."""
    rows = sorted((r for r in rows if r[0] is not None and r[1] is not None and len(r[2] or "") >= shortest), key=lambda r: r[1])
    found = set()
    for i, (g, a, x) in enumerate(rows):
        for h, b, y in rows[i + 1 :]:
            if g != h or a == b or 2 * min(len(x), len(y)) < least * (len(x) + len(y)) - 1e-9:
                continue
            match = SequenceMatcher(None, x, y)
            if match.quick_ratio() >= least and match.ratio() >= least:
                found.add((g, a, b))
    return found


def edited(rng, text, spread):
    """The text with an edit in about every ``spread`` characters."""
    out = []
    for c in text:
        pick = rng.random() * spread
        out.append("" if pick < 0.4 else c + rng.choice("abcx ") if pick < 0.8 else c)
    return "".join(out).strip()


def test_equals_all_pairs_of_edited_texts(spark):
    rng, rows = random.Random(5), []
    for k in range(12):
        base = " ".join(rng.choice(("ward", "note", "of", "the", "bill", "a", "surgery")) + rng.choice(("", "s", "q", "1")) for _ in range(rng.choice((8, 9, 12, 40, 150))))
        for j in range(12):
            rows.append((f"g{k % 3}", 100 * k + j, edited(rng, base, rng.choice((10, 18, 25, 80, 10**9)))))
    rows += [("g0", 9001, "same body " * 5), ("g0", 9002, "same body " * 5), ("g1", 9003, "same body " * 5), ("g0", 9004, "short"), ("g0", 9005, ""), ("g0", 9006, None), (None, 9007, "same body " * 5), ("g0", None, "same body " * 5)]
    got = {(r.group, r.a, r.b) for r in near_pairs(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    expected = all_pairs(rows)
    assert got == expected and ("g0", 9001, 9002) in got and len(expected) > 60
    sizes = {len(r[2]) for r in rows if r[2]}
    assert min(sizes - {5}) < 50 and max(sizes) > 500


def test_equals_all_pairs_of_the_documents(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").select(F.concat_ws("/", "source", "lang").alias("group"), F.col("doc_id").alias("page"), squash(F.col("text")).alias("body"))
    once = [tuple(r) for r in docs.groupBy("group", "body").agg(F.min("page").alias("page")).select("group", "page", "body").collect()]
    # a second scan of every third one, with few or many edits
    rng = random.Random(8)
    twice = once + [(g, -1 - page, edited(rng, body, rng.choice((30, 300, 3000)))) for g, page, body in once if page % 3 == 0]
    got = {(r.group, r.a, r.b) for r in near_pairs(spark.createDataFrame(twice, PAGES)).collect()}
    expected = all_pairs(twice)
    assert got == expected and len(expected) > 20
    plain = {(r.original_page, r.copy_page) for r in near_dup_pairs(spark, at).collect()}
    assert plain == {(a, b) for _, a, b in all_pairs(once)}


def test_fingerprints_must_agree_too(spark):
    body = "the same page of the same claim, scanned once more"
    rows = [("g", 1, body, 0), ("g", 2, body, 0b11111), ("g", 3, body, 0b111111), ("g", 4, body, None)]
    got = {(r.a, r.b) for r in near_pairs(spark.createDataFrame(rows, PAGES + ", fingerprint long"), most_bits=5).collect()}
    assert got == {(1, 2), (2, 3)}


def test_nothing_to_compare(spark):
    assert near_pairs(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("least, shortest", [(0.95, 40), (0.9, 40), (0.8, 40), (0.98, 20)])
def test_every_length_holds_its_segments(least, shortest):
    s = Segments(least, shortest)
    for length in [*range(shortest, 600), 5_000, 99_999]:
        edits = int(s.edits * length)
        assert (edits + 1) * s.size <= length
        least_partner = min(m for m in range(max(shortest, int(length / s.growth) - 2), length + 1) if 2 * m >= least * (m + length) - 1e-9)
        assert s.class_of(length) - s.class_of(least_partner) <= 1 and edits <= s.reach(s.class_of(least_partner))
    with pytest.raises(ValueError):
        Segments(0.5, 1)


def test_blocks_and_bounds_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 5)  # many blocks a class
    rng = random.Random(11)
    rows = []
    for k in range(6):
        base = "".join(rng.choice(("th", "er", "in", "on ", "q7", "es ", "the ")) for _ in range(rng.choice((15, 60, 300))))
        rows += [("g", 50 * k + j, edited(rng, base, rng.choice((25, 60, 10**9)))) for j in range(12)]
    got = {(r.group, r.a, r.b): r.similarity for r in near_pairs(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert set(got) == all_pairs(rows) and len(got) > 20
    body = {page: text for _, page, text in rows}
    assert all(similarity == SequenceMatcher(None, body[a], body[b]).ratio() for (_, a, b), similarity in got.items())


def test_texts_of_the_same_letters_are_no_candidates():
    rng = random.Random(3)
    syllables = [a + b + c for a in "tnsrl" for b in "aeio" for c in ("", "n", "s ")]
    bodies = ["".join(rng.choice(syllables) for _ in range(700))[:1500] for _ in range(40)]
    bodies += [bodies[0][:700] + bodies[0][702:]]
    found = list(similar.candidates(bodies, np.ones(41, bool), np.zeros(41, int), True, 0.95))
    assert len(found) < 10 and similar.ratio(bodies[1], bodies[2], 0.95) is None
