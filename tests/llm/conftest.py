import random

import pytest

EN, DE, ES = "the of and to in is that it was for on are as with".split(), "der die und in den von zu das mit sich".split(), "de la que el en los se del las un".split()


def words(rng, n, vocabulary):
    return [rng.choice(vocabulary) + rng.choice(("", "er", "ing", "ab", "ol", "ux")) + rng.choice(("", "a", "i", "o")) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs():
    """Texts with copies, near copies, shared passages, nulls, empties, ties, repeated rows and a very long text."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60, EN))
    rows = []
    for k in range(40):
        body = words(rng, rng.randint(5, 200), (EN, DE, ES)[k % 3])
        if k % 4 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage.split()
        rows.append((k, " ".join(body) + ("\nthe end of it\n" * (k % 5)), ("en", "de", "es")[k % 3], f"s{k % 7 if k % 2 else 0}"))
    rows += [(100 + k, rows[8][1], "en", "s0") for k in range(6)]  # copies
    rows += [(110 + k, rows[12][1] + f" tail{k}", "en", "s0") for k in range(6)]  # near copies
    rows += [(120, None, "en", None), (121, "", None, "s1"), (122, " \n\t ", "en", "s1"), (123, "x", "de", "s2"), (124, "é" * 150 + " ñandú", "es", None)]
    rows += [(130, "a " * 3000 + passage, "en", "s3"), (131, "ab" * 400, "en", "s3"), (132, "ab" * 300, "en", "s3")]
    rows += [(None, passage, "en", "s4"), (140, rows[4][1], "en", "s0"), (140, rows[4][1], "en", "s0"), (140, "other text for one id " * 9, "en", "s5")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_docs):
    """As a table with columns whose names the operators use inside."""
    rows = [(a, b, c, d, len(b) if b is not None else None, 7, "k") for a, b, c, d in odd_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, twin int, spans string").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
