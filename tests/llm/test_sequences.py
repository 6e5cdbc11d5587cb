"""Operators 1, 2 and 9 and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dossier.llm import chat, mixing, packing, simhash, toxicity
from dossier.llm.registry import oracle_sql, queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, sf, name):
    same(spark, queries()[name], oracle_sql()[name], sf)


def plain_best_fit(items, capacity):
    bins = []
    for size in sorted(items, reverse=True):
        fits = [(r, k) for k, r in enumerate(bins) if r >= size]
        if fits:
            bins[min(fits)[1]] -= size
        else:
            bins.append(capacity - size)
    return sorted(bins)


def test_best_fit_decreasing_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([1, 7, 20, 64, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        rows, n = packing.best_fit_decreasing(dict(Counter(items)), capacity)
        used, seen = defaultdict(list), Counter()
        for size, _, count, first, per, offset in rows:
            for i in range(count):
                used[first + i // per].append((offset + size * (i % per), size))
                seen[size] += 1
        assert seen == Counter(items) and sorted(used) == list(range(n))
        assert sorted(capacity - sum(s for _, s in u) for u in used.values()) == plain_best_fit(items, capacity)
        for u in used.values():
            at = 0
            for offset, size in sorted(u):
                assert offset == at
                at += size


def test_ids_equal_the_tokenizers(odd_docs):
    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer, ids = Tokenizer.from_file(path), packing.Ids(path)
    odd = ["don't STOP 12½ ﬁ İstanbul ΣΑΣ x<|endoftext|>y", "a\x1cb\x1fc", "é café", "日本語 テスト", "​ zero\xa0w", "naïve Ǆ × ÷ ³² ­", "we'll 'S I'M", "@#$ a1b2"]
    texts = [t for _, t, *_ in odd_docs] + odd
    for text, got in zip(texts, ids.of(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_packing(spark, docs, odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack(docs, 64).collect()
    expected = Counter()
    for i, text, *_ in odd_docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            expected[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for u in used.values():
        at = 0
        for offset, length in sorted(u):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == len(plain_best_fit([r.length for r in got], 64))
    assert packing.pack(no_docs).count() == 0


def test_sequences_hold_the_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    packed = packing.pack(docs).cache()
    found = {r.sequence_id: r for r in packing.sequences(docs, packed).collect()}
    for r in packed.collect():
        own = found[r.sequence_id].ids[r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert all(len(r.ids) <= packing.CAPACITY for r in found.values())


def test_mixing_meets_its_limits(spark, docs, odd_docs, no_docs):
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have = Counter()
    for _, t, _, s in odd_docs:
        have[s] += tokens(t)
    got = mixing.mix(docs, 1.0, 1.5, block_tokens=500).collect()
    out, epochs = Counter(), Counter()
    for r in got:
        out[r.source] += r.tokens
        epochs[r.source] = max(epochs[r.source], r.epoch)
    total = sum(have.values())
    assert sum(out.values()) <= total
    assert all(out[s] <= 1.5 * n + 1 for s, n in have.items()) and max(epochs.values()) == 1
    blocks = defaultdict(list)
    for r in got:
        blocks[r.block].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values())
    assert mixing.mix(no_docs).count() == 0
    flat = mixing.mix(docs, 3.0, None, 1.0).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    full = [r.n for r in flat if r.n and have[r.source] > 50]
    assert max(full) <= 3 * total / sum(n > 0 for n in have.values()) + 1
    with pytest.raises(ValueError):
        mixing.mix(docs, 1.0, 2.0, 0.5)


def test_bisection_of_entropy(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    t = mixing.bisect(shares, None, None, 0.95)
    w = np.array([0.7, 0.2, 0.1]) ** t
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() / np.log(3) - 0.95) < 1e-6


def test_mixed_documents_keep_everything(docs):
    out = mixing.mixed_documents(docs, 1.5)
    assert out.columns == docs.columns
    fold = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    before, after = fold(docs.collect()), fold(out.collect())
    assert set(before) == set(after) and all(n <= after[k] <= 2 * n for k, n in before.items())


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]\\\\", "[ROLE:x] <s> [/SYS]", "", None, "<\\/s>", "é\n\n[/ANSWER]</s><s>[INST] "]
    roles = ["user", "assistant", "system", "tool] [x", None, "</s>"]
    rows = [(c, t, roles[(c + t) % 6], texts[(3 * c + t) % 8]) for c in range(20) for t in range(c % 9 + 1)] + [(50, 0, "user", "same"), (50, 0, "user", "same"), (None, 1, "user", "x"), (51, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    done = chat.render(chat.fold(chat.as_events(df), chat.MESSAGE), chat.MESSAGE)
    back = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask("formatted", "mask").alias("loss"), "mask").collect()
    expected = defaultdict(list)
    for c, t, r, x in rows:
        expected[c].append((-1 if t is None else t, r or "", x or ""))
    for row in back:
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in sorted(expected[row.conv_id])]
        assert row.loss == [x for _, r, x in sorted(expected[row.conv_id]) if r == "assistant"]
        assert all(row.formatted[m.start + m.length :].startswith(" [/ANSWER]</s>") and row.formatted[: m.start].endswith("<s>[ANSWER] ") for m in row.mask)
    assert len(back) == len(expected)
    assert chat.render(chat.fold(chat.as_events(df.filter("false")), chat.MESSAGE), chat.MESSAGE).count() == 0


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 2, 0, "message", "assistant", "dra"), (1, 2, 1, "delta", None, "ft"), (1, 2, 2, "regenerate", "assistant", "ne"), (1, 2, 3, "delta", None, "w"), (1, 1, 0, "message", "user", "hi"), (1, 1, 9, "edit", None, "ho"), (1, 3, 4, "delta", "user", "b"), (1, 3, 3, "delta", None, "a")]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert sorted((r.message, r.role, r.text) for r in got.collect()) == [(1, "user", "ho"), (2, "assistant", "new"), (3, "user", "ab")]


def test_the_log_holds_deltas_edits_and_regenerations(spark, sf):
    kinds = {r.kind: r["count"] for r in chat.as_events(spark.read.parquet(f"{sf}/conversations.parquet")).groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > kinds["message"] / 6


def test_a_long_conversation_costs_in_proportion(spark):
    """20,000 turns in one conversation: time per turn stays near that of 2,000 (it grew tenfold when each span was counted from the start)."""

    def seconds(turns):
        rows = spark.range(turns).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('some words of turn ', id, ' </s> [INST]') AS text")
        begun = time.time()
        done = chat.render(chat.fold(chat.as_events(rows), chat.MESSAGE), chat.MESSAGE)
        row = done.select(F.size(chat.parse(F.col("formatted"))).alias("n"), F.array_join(chat.under_mask("formatted", "mask"), "|").alias("loss")).first()
        assert row.n == turns and row.loss == "|".join(f"some words of turn {k} </s> [INST]" for k in range(1, turns, 2))
        return time.time() - begun

    seconds(200)
    assert seconds(20_000) < 4 * seconds(2_000) + 10


def test_pipeline_equals_its_parts(spark, docs, odd_docs, tmp_path):
    labels = [(k, int(k % 5 == 1)) for k in range(40)]
    sf = str(tmp_path)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    # texts that share four fifths of their five-word runs with document 1, and a text that shares less
    body = (odd_docs[1][1] + " " + odd_docs[2][1]).split()
    near = [(200, " ".join(body)), (201, " ".join([*body, "a", "few", "words", "more"])), (202, " ".join(["z"] * 5 + body)), (203, " ".join(body[: len(body) * 2 // 3])), (None, " ".join([*body, "end"]))]
    plain = plain.unionByName(spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in near], "doc_id long, text string, lang string, source string, n_chars int"))
    plain.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    # rows in order of doc_id, null last; those of one id by text
    rows = sorted(((r.doc_id, r.text) for r in plain.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    model = toxicity.learn(plain, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in rows if model.scores([r[1]])[0] < 0.5]

    def runs(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ")
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", words) if w]
        return Counter([tuple(words)] if 0 < len(words) <= 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])

    marks, group = [runs(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            together = sum((marks[a] | marks[b]).values())
            if (sum((marks[a] & marks[b]).values()) >= 0.8 * together if together else True) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    # of a component the row that comes first stays
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    assert {200, 203} <= {i for i, _ in rows} and not {201, 202} & {i for i, _ in rows}
    first, kept_rows = {}, []
    for at_row, (i, text) in enumerate(rows):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - 99):
            if first.setdefault(data[p : p + 100], (at_row, p)) != (at_row, p):
                mark[p : p + 100] = b"\1" * 100
        if text is not None:
            kept, at = [], 0
            for ch in text:
                n = len(ch.encode())
                if not all(mark[at : at + n]):
                    kept.append(ch)
                at += n
            text = "".join(kept)
        kept_rows.append((i, text))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    expected = Counter()
    for i, text in kept_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            expected[i, k // 2048, zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    found = Counter((r.doc_id, r.piece, r.ids_crc32) for r in out)
    assert set(found) == set(expected) and all(expected[k] <= found[k] <= 2 * expected[k] for k in expected)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "mixing", "packing"]


def test_pipeline_of_nothing(spark, docs, tmp_path):
    sf = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").filter("false").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
