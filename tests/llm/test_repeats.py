"""Operators 4 and 10 against brute force."""

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import recompression, spans, suffix_dedup
from dossier.llm.registry import queries

FAR = 2**63 - 1


def keyed(odd_docs):
    """(id, twin, text) in the order the operators define."""
    seen, out = {}, []
    for i, t in sorted(((FAR if i is None else i, t) for i, t, *_ in odd_docs), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        seen[i] = seen.get(i, -1) + 1
        out.append((i, seen[i], t))
    return out


def bytes_removed(rows, window):
    first, out = {}, []
    for i, twin, text in rows:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - window + 1):
            low, own = first.setdefault(data[p : p + window], (i, set()))
            if low < i or (i, twin) in own:
                mark[p : p + window] = b"\1" * window
            own.add((i, twin))
        out.append((i, text, mark))
    return out


def spans_of(mark):
    return [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(mark))]


@pytest.mark.parametrize("window,gram,batches,width,few", [(100, 16, 4, 8, 500_000), (30, 12, 5, 4, 0), (100, 40, 1, 1, 500_000)])
def test_suffix_arrays_remove_what_brute_force_removes(spark, docs, odd_docs, window, gram, batches, width, few):
    found = suffix_dedup.remove_repeats(docs, window, gram, batches, width, few).collect()
    got = sorted((FAR if r.row.doc_id is None else r.row.doc_id, r.text or "", spans.union_of([s.asDict() for s in r.spans or ()])) for r in found)
    assert got == sorted((i, t or "", spans_of(m)) for i, t, m in bytes_removed(keyed(odd_docs), window))


def test_strip_cuts_whole_characters_and_keeps_columns(spark, docs, odd_docs):
    out = suffix_dedup.strip_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) and (r.twin, r.spans) == (7, "k")
    # nothing of 100 characters repeats any more, but for what a cut character kept
    texts = [r.text for r in out.collect() if r.text and r.text.isascii()]
    assert sum(len(t) for t in texts) < sum(len(t) for _, t, *_ in odd_docs if t and t.isascii())


@pytest.mark.parametrize("window,gram,rounds,few", [(13, 5, 1, 500_000), (13, 5, 2, 0), (13, 3, 3, 500_000), (6, 2, 1, 500_000)])
def test_recompression_removes_what_brute_force_removes(spark, docs, odd_docs, window, gram, rounds, few):
    found = recompression.remove_repeats(docs, window, gram, rounds, few).collect()
    got = sorted((FAR if r.row.doc_id is None else r.row.doc_id, r.text or "", spans.union_of([s.asDict() for s in r.spans or ()])) for r in found)
    first, expected = {}, []
    for i, twin, text in keyed(odd_docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        mark = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if first.setdefault(tuple(w[p : p + window]), i) < i:
                mark[p : p + window] = b"\1" * window
        expected.append((i, text or "", spans_of(mark)))
    assert got == sorted(expected)


def test_runs_of_one_token(spark):
    rows = [(1, "a " * 40), (2, "b " + "a " * 30), (3, "a " * 13), (4, "a " * 12), (5, ("a b " * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: spans.union_of([s.asDict() for s in r.spans or ()]) for r in recompression.remove_repeats(df).collect()}
    assert got == {1: [], 2: [(1, 31)], 3: [(0, 13)], 4: [], 5: []}


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_long_words_that_differ_are_not_equal(spark):
    """A polynomial modulo 2**64 gives this word of 1,024 letters and its complement one value."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(["w"] * 6 + [word] + ["v"] * 6)), (2, " ".join(["w"] * 6 + [other] + ["v"] * 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(not r.spans for r in recompression.remove_repeats(df).collect())


def test_rows_that_share_a_doc_id_are_not_earlier_than_each_other(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(7, text), (7, text + " end"), (9, text)], "doc_id long, text string")
    for operator, size in ((recompression, 30), (suffix_dedup, len(text))):
        got = sorted((r.row.doc_id, spans.union_of([s.asDict() for s in r.spans or ()])) for r in operator.remove_repeats(df).collect())
        assert got == [(7, []), (7, []), (9, [(0, size)])]


def test_recompression_needs_a_round(docs):
    with pytest.raises(ValueError, match="rounds"):
        recompression.remove_repeats(docs, rounds=0)


def test_common_prefixes_come_from_suffix_order():
    """Neighbours in suffix order have the longest common prefixes; in any other order long matches are missed."""
    rng = np.random.default_rng(3)
    tails = [bytes(rng.integers(97, 99, 40, dtype=np.uint8)) for _ in range(300)]
    best = [max(len(os.path.commonprefix([a[:32], b[:32]])) for k, b in enumerate(tails) if k != j) for j, a in enumerate(tails)]

    def longest(order):
        head, size = suffix_dedup.heads(pa.array([tails[k][:32] for k in order], pa.binary()))
        shared = suffix_dedup.common_prefix(head, size)
        return dict(zip(order, np.maximum(np.r_[0, shared], np.r_[shared, 0]).tolist(), strict=True))

    assert [n for _, n in sorted(longest(sorted(range(300), key=lambda k: tails[k])).items())] == best
    assert [n for _, n in sorted(longest(list(range(300))).items())] != best


def test_levels_merge_geometrically(spark, docs, tmp_path, monkeypatch):
    """Four batches: the second merges with the first, the fourth with the third and then with both."""
    seen = []
    scanned = suffix_dedup.scanned
    monkeypatch.setattr(suffix_dedup, "scanned", lambda rows, window, last: seen.append(rows.groupBy(F.expr("flag & 3")).count().collect()) or scanned(rows, window, last))
    suffix_dedup.remove_repeats(docs).count()
    kinds = [{r[0] for r in rows} for rows in seen]
    assert kinds == [{0}, {0, 2}, {0, 3}, {0, 2}]


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0 and recompression.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.strip_repeats(no_docs).count() == 0


def test_names_are_the_same_in_the_interior_of_equal_strings():
    rng = np.random.default_rng(0)
    inner = rng.integers(0, 2**63, 200, dtype=np.uint64)
    seen = []
    for side in (rng.integers(0, 2**63, 50, dtype=np.uint64), rng.integers(0, 2**63, 31, dtype=np.uint64)):
        name = np.r_[side, inner, side]
        at = np.arange(len(name))
        symbol = (name, at, at, at + 1, np.zeros(len(name), int))
        for k in (1, 2, 3):
            symbol = recompression.recompress(*symbol, k)
        lo, hi = len(side), len(side) + len(inner)
        inside = (symbol[2] >= lo) & (symbol[3] <= hi)
        seen.append((symbol[0][inside].tolist(), (symbol[1][inside] - lo).tolist()))
    assert seen[0] == seen[1] and len(seen[0][0]) > 20


def test_queries_on_the_small_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries()["op4_suffix_dedup"](spark, sf).collect()}
    for i, text, mark in bytes_removed([(i, 0, t) for i, t in docs], 100):
        data = (text or "").encode()
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        assert tuple(got[i]) == (i, len(data), sum(mark), len(spans_of(mark)), hashlib.sha256(kept).hexdigest())
