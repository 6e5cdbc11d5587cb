"""Overlap of intervals against all pairs, and its plan; words of spans against all words."""

import random

from dossier.operators import intervals
from dossier.plans import paper


def test_equals_all_pairs(spark, capsys):
    rng = random.Random(1)
    make = lambda n: [(rng.choice("abc"), s := rng.randint(-50, 500), s + rng.choice((0, 1, 3, 70, 300)), k) for k in range(n)]  # noqa: E731, F841
    left, right = make(80) + [(None, 0, 9, -1), ("a", None, 5, -2)], make(90) + [("a", 0, 10_000, -3), (None, 0, 9, -4)]
    schema = "k string, start long, end long, n long"
    pairs = intervals.overlapping(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema), ["k"], 16)
    expected = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] is not None and x[1] is not None and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r.l.n, r.r.n) for r in pairs.collect()) == expected and len(expected) > 100
    pairs.explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_words_of_spans_equal_all_words(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "  ä\u20ac  b", None, "x" * 300] + ["".join(rng.choice("ab\u00fc \n\U0001f600 ") for _ in range(rng.randint(0, 400))) for _ in range(80)]
    spans = [[(s := rng.randint(-5, 420), s + rng.choice((0, 1, 9, 500))) for _ in range(rng.randint(0, 12))] for _ in texts[1:]] + [None]
    monkeypatch.setattr(intervals, "AT_ONCE", 700)
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts, spans, strict=True)), "k long, text string, spans array<struct<start: int, end: int>>")
    found = sorted((r.k, r.start, r.end, [tuple(w) for w in r.words]) for r in intervals.words_touched(frame.repartition(2), ["k"]).collect())
    expected = []
    for k, (text, some) in enumerate(zip(texts, spans, strict=True)):
        at, words = 0, []
        for word in (text or "").split(" "):
            words.append((at, at + len(word), word))
            at += len(word) + 1
        for start, end in some or ():
            if end > start and (hit := [w for w in words if w[2] and w[0] < end and w[1] > start]):
                expected.append((k, start, end, hit))
    assert found == sorted(expected) and len(expected) > 100


def test_only_documents_are_shuffled(spark, sf):
    plan = paper.span_words(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(step in plan for step in ("Join", "Window", "Generate", "Sort "))
