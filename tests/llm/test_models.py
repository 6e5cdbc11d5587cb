"""Operators 3, 5 and 8: exact features, probabilities that sum to one, held-out accuracy."""

import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import langid, quality, toxicity


def test_kneser_ney_sums_to_one():
    keys, counts = np.unique(langid.grams(["the and of that thing there then"])[0], return_counts=True)
    model = langid.KneserNey(keys, counts, 40)
    seen = np.unique(keys & np.uint64(0xFFFF))
    symbols = np.r_[seen, np.arange(60000, 60000 + 40 - len(seen), dtype=np.uint64)]
    for context in {*(keys >> np.uint64(16)).tolist(), 123456789}:
        total = model.probability(4, (np.uint64(context) << np.uint64(16)) | symbols).sum()
        assert abs(total - 1) < 1e-9


def test_side_by_side_tables_equal_the_models():
    texts = {"a": "the thing then and there", "b": "der dann und die dinge"}
    parts = [(k, *np.unique(langid.grams([t])[0], return_counts=True)) for k, t in texts.items()]
    models = langid.Models(parts)
    symbols = 1 + len(np.unique(np.concatenate([p[1] & np.uint64(0xFFFF) for p in parts])))
    asked = langid.grams(["then dinge xyz the"])[0]
    expected = np.stack([np.log(langid.KneserNey(k, c, symbols).probability(4, asked)) for _, k, c in parts], 1)
    assert np.allclose(models.scores(asked), expected, atol=1e-4)


def test_grams_do_not_depend_on_neighbours():
    one = [langid.grams([t])[0].tolist() for t in ("ab c", "", "12 é")]
    keys, row = langid.grams(["ab c", "", "12 é"])
    assert [keys[row == k].tolist() for k in range(3)] == one


def test_languages_of_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.identify(docs, *langid.fit(docs.select("doc_id", "lang", "text"))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in found)


def test_undetermined_texts(spark, docs, no_docs):
    model = langid.fit(docs.select("doc_id", "lang", "text"))
    got = {r.doc_id: r for r in langid.identify(docs, *model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and not got[k].accepted for k in (120, 121, 122))
    assert got[123].lang_pred in ("en", "de", "es") and len(got) == docs.select("doc_id").distinct().count()
    assert langid.identify(no_docs, *model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, *langid.fit(no_docs)).collect()} == {"und"}


def test_long_texts_are_read_in_slices(monkeypatch):
    texts = ["the thing and then " * 40, "x", "und der " * 90]
    parts = [(k, *np.unique(langid.grams([t])[0], return_counts=True)) for k, t in (("a", texts[0]), ("b", texts[2]))]
    models = langid.Models(parts)
    whole = models.entropies(texts)
    monkeypatch.setattr(langid, "SLICE", 50)
    cut = models.entropies(texts)
    assert np.array_equal(whole[1], cut[1]) and np.allclose(whole[0], cut[0])


def plain_features(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = [0] * len(w)
    for i in range(len(w) - 2):
        if counts[tuple(w[i : i + 3])] > 1:
            mark[i : i + 3] = [1] * 3
    seen, again = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), again, sum(mark)


def test_quality_features_equal_brute_force(spark, docs, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, 1) for k in range(0, 40, 2)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.judged(docs, labels).collect()
    fold = lambda i: -1 if i is None else i
    got = sorted((fold(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((fold(i), *plain_features(t)) for i, t, *_ in odd_docs)
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.judged(no_docs, labels).count() == 0
    assert all(r.kept == (not r.base_failed) for r in quality.judged(docs, labels.filter("false")).collect())


def test_quality_separates_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.op5_quality(spark, sf).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in found}
    assert kept[1] >= 0.98 and kept[0] <= 0.2


def test_quality_uses_no_python(spark, sf, capsys):
    quality.with_features(quality.numbered(spark.read.parquet(f"{sf}/documents.parquet"))).explain()
    assert not re.search("Python|Arrow", capsys.readouterr().out)


def test_folding():
    assert toxicity.fold("You M0R0N, 1d1ot!") == " you moron idiot "
    assert toxicity.fold("ѕсum tr@sh the$$$ 2024") == " scum trash the 2024 "
    assert toxicity.fold(None) == "  " or toxicity.fold(None).strip() == ""


def test_exceptions_and_whole_words():
    matcher = toxicity.Matcher({"trash": 2.0, "clown": 1.0}, ("trash can",))
    assert matcher.features("trash")[2] == 1 and matcher.features("trashy untrash")[2] == 0
    assert matcher.features("a trash can and trash")[2] == 1
    assert matcher.features("trash trash clown")[0] == 5.0
    assert toxicity.Matcher({}, ()).features("trash") == (0.0, 0.0, 0)


def test_very_long_texts_with_exceptions_take_linear_time():
    matcher = toxicity.Matcher({"trash": 2.0}, ("trash can",))
    begun = time.time()
    assert matcher.features("trash can " * 200_000 + "trash")[2] == 1
    assert time.time() - begun < 20


def test_exceptions_are_learned_from_clean_rows(spark):
    rows = [(k, "you trash" if k % 2 else f"the trash can {k} of ours") for k in range(200)] + [(200 + k, "a word of no harm") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2 if k < 200 else 0) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.filter("doc_id < 600"))
    assert dict(model.lexicon).get("you", 0) > 1.5 and all("trash can" not in p or "trash" in dict(model.lexicon) for p in model.exceptions)
    words = {"trash": 2.0}
    assert toxicity.phrases("the trash can".split(), words) == {"the trash", "trash can"} and toxicity.phrases(["trash"], words) == set()


def naive_toxicity(docs, labels):
    """Everything again with plain dictionaries and word lists (all rows are in the sample)."""
    texts = {i: toxicity.fold(t).split() for i, t in docs}
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(texts[i], y) for i, y in labels if 0 < part(i) < 4]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]

    def weights(terms):
        seen = Counter(), Counter()
        for w, y in rows:
            seen[y].update(set(terms(w)))
        return {t: (seen[0][t], seen[1][t], np.log((seen[1][t] + 0.5) / (n[1] + 1)) - np.log((seen[0][t] + 0.5) / (n[0] + 1))) for t in seen[0] | seen[1]}

    lexicon = {t: w for t, (_, hit, w) in weights(lambda w: w).items() if hit >= 3 and w >= 1.5}
    pairs = lambda w: [(a, b) for a, b in zip(w, w[1:]) if a in lexicon or b in lexicon]  # noqa: E731, B905
    spared = {t for t, (clean, _, w) in weights(pairs).items() if clean >= 3 and w <= 0}

    def features(w):
        hits = [lexicon[x] for k, x in enumerate(w) if x in lexicon and not ({tuple(w[k - 1 : k + 1]), tuple(w[k : k + 2])} & spared)]
        return [np.log1p(sum(hits)), np.log1p(100 * sum(hits) / max(1, len(w))), np.log1p(len(hits))]

    fit = np.array([[*features(texts[i]), y] for i, y in labels if part(i) == 4])
    fit = fit[np.lexsort(fit.T)]
    curve = toxicity.curve(fit[:, :3], fit[:, 3])
    return {i: 1 / (1 + np.exp(-np.clip(np.r_[features(w), 1.0] @ curve, -30, 30))) for i, w in texts.items()}


def test_toxicity_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()]
    expected = naive_toxicity(docs, labels)
    got = toxicity.op8_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.score - expected[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


class NaiveKneserNey:
    def __init__(self, counts, symbols):
        self.levels, self.symbols = {}, symbols
        for k in (4, 3, 2, 1):
            ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            total, kinds = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels[k] = counts, total, kinds, ones / (ones + 2 * twos) if ones and twos else 0.5
            counts = Counter(g[1:] for g in counts)

    def probability(self, g):
        if not g:
            return 1 / self.symbols
        counts, total, kinds, discount = self.levels[len(g)]
        lower, c = self.probability(g[1:]), g[:-1]
        return max(counts.get(g, 0) - discount, 0) / total[c] + discount * kinds[c] / total[c] * lower if c in total else lower


def naive_grams(text):
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        seq = (0, 0, 0, *(min(ord(c), 0xFFFF) for c in word), 0)
        yield from (seq[k - 3 : k + 1] for k in range(3, len(seq)))


def test_language_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    counts = {}
    for i, lang, text in rows:
        if lang is not None and fold(i) in (0, 1):
            counts.setdefault(lang, Counter()).update(naive_grams(text))
    symbols = 1 + len({g[3] for c in counts.values() for g in c})
    models = {lang: NaiveKneserNey(c, symbols) for lang, c in sorted(counts.items())}
    _, scale, _ = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"))
    got = {r.doc_id: r for r in langid.op3_langid(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, _, text in rows[::5]:
        grams = Counter(naive_grams(text))
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cross = np.array([-sum(n * np.log(m.probability(g)) for g, n in grams.items()) / sum(grams.values()) for m in models.values()])
        assert got[i].lang_pred == list(models)[int(cross.argmin())] and got[i].held_out == (fold(i) == 2)
        assert abs(got[i].score - 1 / np.exp(-(cross - cross.min()) * scale).sum()) < 1e-3


def test_quality_verdict_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    buckets = quality.buckets_for(0)
    marked = docs.select("doc_id", quality.hashed("w", buckets).alias("g"), F.expr("pmod(xxhash64(doc_id, 1), 2)").alias("half")) if "w" in docs.columns else (
        docs.select("doc_id", quality.words(F.col("text")).alias("w")).select("doc_id", quality.hashed("w", buckets).alias("g"), F.expr("pmod(xxhash64(doc_id, 1), 2)").alias("half"))
    )
    rows = {r.doc_id: r for r in marked.collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()} & rows.keys()
    raw, target = Counter(g for r in rows.values() for g in r.g), Counter(g for i in good if rows[i].half == 0 for g in rows[i].g)
    seen = {g: (n + 1) / (sum(raw.values()) + buckets) for g, n in raw.items()}
    ratio = {g: np.log((target[g] + buckets * p) / (sum(target.values()) + buckets) / p) for g, p in seen.items()}
    score = {i: np.mean([ratio[g] for g in r.g]) if r.g else None for i, r in rows.items()}
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    threshold = min(score[i] for i in good if rows[i].half == 1 and not got[i].base_failed)
    for i, r in got.items():
        assert (score[i] is None and r.score is None) or abs(r.score - score[i]) < 1e-9
        assert r.kept == (not r.base_failed and score[i] >= threshold - 1e-12)


def test_buckets_grow_with_the_root_of_the_corpus():
    assert [quality.buckets_for(n) for n in (0, 1 << 26, 1 << 28, 1 << 46)] == [1 << 16, 1 << 16, 1 << 17, 1 << 26]


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r.predicted for r in found if r.toxic == 1], [r.predicted for r in found if r.toxic == 0]
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.02


def test_toxicity_of_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.select("row.*").columns == docs.columns and scored.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    clashing = docs.withColumns({"__score": F.lit("x"), "score": F.lit(2), "row": F.lit(3), "text2": F.col("text")})
    assert toxicity.keep_clean(clashing, labels).columns == clashing.columns
    assert toxicity.keep_clean(no_docs, labels).count() == 0
    assert toxicity.keep_clean(docs, labels.filter("false")).count() == docs.count()


def test_every_trusted_document_is_counted(spark):
    """More labelled documents than a sample of 20,000 would hold: the sum of target counts is that of the whole half."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    seen = {}

    def spy(d, trusted, scratch, buckets, real=quality.ratios):
        seen["trusted"] = trusted.count()
        return real(d, trusted, scratch, buckets)

    real, quality.ratios = quality.ratios, spy
    try:
        quality.judged(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count()
    finally:
        quality.ratios = real
    assert seen["trusted"] == docs.filter("pmod(xxhash64(doc_id, 1), 2) = 0").count() > 20_000


def test_exact_quantile(spark):
    scores = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).cast("double").alias("score"))
    ordered = sorted(r.score for r in scores.collect())
    for q in (0.0, 0.001, 0.00123, 0.5, 1.0):
        assert quality.exact_quantile(scores, q) == ordered[max(1, -(-int(q * 10**5) * 200_000 // 10**5)) - 1]
    assert quality.exact_quantile(scores.limit(0), 0.5) is None
