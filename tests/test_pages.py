"""What single pages say of themselves, by hand."""

import re

from pyspark.sql import functions as F

from dossier.operators import pages

VOCABULARY = {"bill": (("tax invoice",), ("amount", "payable", "rate"), ("consent",)), "note": (("operative note", "note"), ("surgeon", "incision"), ())}


def reads(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return pages.read(rows.repartition(2), VOCABULARY).orderBy("k").collect()


def test_titles_cover_their_cell(spark):
    whole, capitals, sentence, over, under = reads(
        spark, "Tax Invoice", "COPY OF TAX INVOICE HERE", "copy of the tax invoice here\namount", "Tax Invoice ABC", "Tax Invoice 2024"
    )
    assert (whole.type, whole.method, whole.confidence, whole.named) == ("bill", "title", 0.8, True)
    assert capitals.method == "title" and over.method == "title" and over.named
    assert (sentence.type, sentence.method, sentence.confidence, sentence.runner_up) == ("other", "none", 0.2, "bill")
    assert under.method == "none" and under.runner_up == "bill"


def test_keywords_need_company(spark):
    one, two, against = reads(spark, "amount", "the amount payable at this rate", "amount payable, with consent")
    assert one.type == "other" and (two.type, two.method, two.confidence, two.named) == ("bill", "keywords", 0.52, False)
    assert against.type == "other" and against.runner_up is None


def test_a_page_torn_between_types_names_nothing(spark):
    torn, clear = reads(spark, "Tax Invoice | Operative Note", "Tax Invoice | the Note\nNote")
    assert (torn.type, torn.method, torn.confidence, torn.named, torn.runner_up) == ("note", "title", 0.62, False, "bill")
    assert (clear.type, clear.confidence, clear.named) == ("bill", 0.8, True)  # only the first cell with a phrase counts


def test_numbers_and_counts(spark):
    got = reads(spark, "Invoice No: ab/12-x\nPAGE 2 / 11", "Bill number 12/05/2024 bill no 777", "lab # 9981 claim id c99 page 3of4", None, "", "receipt no 1")
    assert [dict(r.identifiers) for r in got] == [{"bill number": "AB/12-X"}, {}, {"report number": "9981", "claim number": "C99"}, {}, {}, {}]
    assert [(r["at"], r.total) for r in got] == [(2, 11), (None, None), (3, 4), (None, None), (None, None), (None, None)]
    assert got[3].type == got[4].type == "other"


def test_titles_stand_in_the_first_lines_that_are_not_blank(spark):
    late, blank = reads(spark, "x\n" * 12 + "Tax Invoice", "\n \n" * 20 + "x  Tax Invoice")
    assert late.method == "none" and blank.method == "title"


def test_only_the_first_lines_of_a_text_are_cut(spark, capsys):
    texts = ["", " \n  \n", "\n" * 9000 + "a  b\r\n \n\t\n  c | d", "x\n \n" * 40 + "y", "one line " * 9000, " a", "a\n" * 12 + "b", "\n\n".join(map(str, range(14))) + "\n"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pages.headings(F.col("text")).alias("cells"))
    for r in got.collect():
        lines = [x for x in r.text.split("\n") if x.strip(" ")][:12]
        assert r.cells == [c for x in lines for c in (y.strip(" ") for y in re.split(r" \| |\s{2,}", x)) if c]
    got.explain(True)
    assert "split(text" not in capsys.readouterr().out


def test_guards_lose_no_number(spark):
    for label, (words, between) in pages.ANNOUNCED.items():
        said = [f"{w.replace('?', '')} {b}: a12".upper() for w in words for b in between] + ["PREAUTH no A12", "Pre-Auth # a12"] * (label == "claim number")
        assert [dict(r.identifiers).get(label) for r in reads(spark, *said)] == ["A12"] * len(said)


def test_no_pages(spark):
    assert pages.read(spark.createDataFrame([], "k long, text string"), VOCABULARY).count() == 0
