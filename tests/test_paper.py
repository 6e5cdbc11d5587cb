"""Rows of boxes against a fold in plain Python; bill tables by position on printed lines."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import ocr, tables

BOXES = "page long, seq long, text string, left double, top double, right double, bottom double, confidence double"


def rows_of(boxes):
    """seq -> row number, by the rule: the first row whose last box overlaps half a height and no width."""
    lasts, given = [], {}
    for _, seq, _, left, top, right, bottom, _ in sorted(boxes, key=lambda b: (b[4], b[3], b[1])):
        for i, (p, q, r, s) in enumerate(lasts):
            if min(bottom, s) - max(top, q) >= 0.5 * min(bottom - top, s - q) and min(right, r) <= max(left, p):
                break
        else:
            i = len(lasts)
            lasts.append(None)
        lasts[i], given[seq] = (left, top, right, bottom), i
    return given


def scattered(page, n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        left, top = rng.randint(0, 60), rng.choice((rng.randint(0, 40), 100 + rng.randint(0, 40), 37))
        out.append((page, k, rng.choice(("a", "bb c", " d  ee ", "", None)), float(left), float(top), float(left + rng.randint(0, 30)), float(top + rng.randint(0, 12)), rng.choice((None, 0.5, 0.9))))
    return out


def test_rows_equal_the_fold(spark):
    pages = [scattered(p, n, p) for p, n in ((1, 60), (2, 1), (3, 200), (4, 7))]
    found = ocr.rows(spark.createDataFrame([b for p in pages for b in p], BOXES).repartition(5), ["page"]).collect()
    for page in pages:
        here = sorted((r for r in found if r.page == page[0][0]), key=lambda r: (r.band, r.row))
        dense = {place: i for i, place in enumerate(dict.fromkeys((r.band, r.row) for r in here))}
        assert {r.seq: dense[r.band, r.row] for r in here} == rows_of(page)
    assert len({(r.page, r.band) for r in found if r.page == 3}) > 1  # the page is cut


def test_lines_and_word_boxes(spark):
    boxes = [(1, 0, "Member Name:", 10.0, 10.0, 130.0, 20.0, 0.5), (1, 1, "Asha  Rao", 200.0, 12.0, 240.0, 21.0, 1.0), (1, 2, "", 300.0, 11.0, 310.0, 20.0, 0.1), (1, 3, "below", 200.0, 30.0, 200.0, 40.0, None)]
    first, second = ocr.lines(spark.createDataFrame(boxes, BOXES), ["page"]).orderBy("line").collect()
    assert (first.line, first.text, first.confidence) == (0, "Member Name:  Asha Rao", 0.75) and tuple(first.box) == (10.0, 10.0, 240.0, 21.0)
    assert [(w.text, w.left, w.right) for w in first.words] == [("Member", 10.0, 70.0), ("Name:", 80.0, 130.0), ("Asha", 200.0, 220.0), ("Rao", 225.0, 240.0)]
    assert (second.line, second.text, second.confidence) == (1, "below", None)
    assert ocr.lines(spark.createDataFrame([], BOXES), ["page"]).count() == 0
    half = ocr.scaled(spark.createDataFrame([(1, 0, "x", 0.1, 0.2, 0.5, 0.4, None)], BOXES), F.lit(100.0), F.lit(50.0)).first()
    assert (half.left, half.top, half.right, half.bottom) == (10.0, 10.0, 50.0, 20.0)


def test_pages_as_arrays_give_the_same_lines_and_shuffle_documents_once(spark, sf):
    from dossier.plans import paper

    boxes = spark.createDataFrame([b for p, n in ((1, 60), (2, 1), (3, 200), (4, 7)) for b in scattered(p, n, p)], BOXES)
    pages = boxes.groupBy("page").agg(F.collect_list(F.struct(*(c for c in boxes.columns if c != "page"))).alias("boxes"))
    one, other = (sorted(map(str, f(t, ["page"]).collect())) for f, t in ((ocr.lines, boxes), (ocr.page_lines, pages)))
    assert one == other and len(one) > 40
    assert ocr.page_lines(pages.limit(0), ["page"]).count() == 0
    for query in (paper.ocr_lines, paper.ocr_words):
        assert query(spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the documents


def words(doc, page, line, *phrases):
    out = []
    for x, text in phrases:
        for w in text.split(" "):
            out.append((doc, page, line, float(x), float(x + 5 * len(w)), w))
            x += 5 * len(w) + 3
    return out


HEAD = ((20, "Sl."), (60, "Particulars"), (200, "Batch"), (250, "Exp"), (300, "Qty"), (350, "Rate"), (420, "Amount (Rs.)"))


@pytest.fixture
def read(spark):
    rows = [
        *words(1, 1, 0, *HEAD),
        *words(1, 1, 1, (20, "1."), (60, "Absorbable haemostatic clips of titanium (ML)"), (300, "2"), (352, "10.50"), (430, "21.00")),  # runs under the batch column
        *words(1, 1, 2, (20, "2"), (60, "Gauze"), (200, "B12"), (250, "05/26"), (310, "1,000"), (385, "1.25"), (425, "1,250.00")),  # rate beside its header
        *words(1, 1, 3, (20, "3"), (60, "Refund"), (425, "(75.00)")),
        *words(1, 1, 4, (20, "4"), (60, "no amount")),
        *words(1, 1, 5, (60, "Sub Total"), (425, "1,196.00")),
        *words(1, 1, 6, (60, "Subtotal"), (425, "9.00")),
        *words(1, 1, 7, (60, "Discount"), (425, "as agreed")),
        *words(1, 2, 0, (20, "1"), (60, "other page, no header"), (425, "5.00")),
        *words(1, 2, 1, (60, "GST"), (425, "-3.00")),
        *words(2, 1, 0, (20, "Sl."), (60, "Particulars"), (200, "Remarks")),  # no amount: no header
        *words(2, 1, 1, (20, "1"), (60, "x"), (200, "5.00")),
        *words(2, 1, 2, (60, "Grand Total"), (425, "7.00")),
        *words(3, 1, 0, (20, "TAX INVOICE")),
    ]
    return tables.read_lines(spark.createDataFrame(rows, "doc long, page long, line long, left double, right double, text string").repartition(3)).cache()


def test_rows_of_a_bill(read):
    got = [tuple(str(x) for x in r[:10]) for r in tables.bill_rows(read).orderBy("doc", "page", "line").collect()]
    assert got == [
        ("1", "1", "1", "1", "Absorbable haemostatic clips of titanium (ML)", "2", "10.50", "21.00", "None", "None"),
        ("1", "1", "2", "2", "Gauze", "1,000", "1.25", "1250.00", "B12", "05/26"),
        ("1", "1", "3", "3", "Refund", "None", "None", "-75.00", "None", "None"),
    ]


def test_totals_notes_and_fields(read):
    got = sorted((r.doc, r.name, str(r.amount), r.page, r.line) for r in tables.bill_totals(read).collect())
    assert got == [(1, "subtotal", "1196.00", 1, 5), (1, "tax", "-3.00", 2, 1), (1, "total", "1196.00", 1, 5), (2, "total", "7.00", 1, 2)]
    assert [tuple(r) for r in tables.bill_notes(read).collect()] == [(1, "Discount as agreed")]
    fields = {(r.doc, r.key): (r.value, r.display, r.snippet) for r in tables.bill_fields(read).collect()}
    assert fields[1, "billing.line_item_count"] == ("3", "3", "1. · Absorbable haemostatic clips of titanium (ML) · 2 · 10.50 · 21.00")
    assert fields[1, "billing.total"] == ("1196.00", "1,196.00", "Sub Total · 1,196.00") and (3, "billing.total") not in fields


def test_items_are_printed_once_and_words_shuffled_once(spark, sf):
    from dossier.plans import paper

    plan = paper.bill_table_rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("Exchange hashpartitioning(") <= 2


@pytest.mark.parametrize("name, dealt", [("bill_table_notes", 2), ("bill_table_rows", 1), ("bill_table_fields", 1)])
def test_lines_of_bills_are_not_dealt_out_or_sorted(spark, sf, name, dealt):
    from dossier.plans import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # items by order; the few notes once more, to be distinct
    assert plan.count("Exchange hashpartitioning(") == dealt and sum("Sort [" in line for line in plan.splitlines()) == 1 and "SortAggregate" not in plan


def test_words_laid_out_are_the_words_printed(spark, sf):
    from dossier.plans import paper

    found = paper.laid_out(paper.printed_phrases(spark, sf).toArrow())
    assert sorted(map(str, found.to_pylist())) == sorted(str(r.asDict()) for r in paper.printed_bills(spark, sf).collect())


def test_many_items_are_dealt_out_more_widely(spark, sf, monkeypatch):
    from dossier.plans import paper

    before = sorted(map(str, paper.bill_table_fields(spark, sf).collect()))
    monkeypatch.setattr(paper, "AT_ONCE", 500)
    found = paper.bill_table_fields(spark, sf)
    assert "Exchange hashpartitioning(l_orderkey" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
    assert sorted(map(str, found.collect())) == before


def test_lines_and_fields_do_not_depend_on_pieces(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for doc in (*range(40), None):
        for page in (1, 2):
            rows += words(doc, page, 0, *HEAD)
            for line in range(1, rng.randint(2, 5)):
                rows += words(doc, page, line, (20, f"{line}"), (60, rng.choice(("Gauze", "clips of titanium", ""))), (rng.choice((200, 300)), "7"), (425, rng.choice(("5.00", "no"))))
            rows += words(doc, page, 7, (60, rng.choice(("Sub Total", "Grand Total", "GST", "thanks"))), (425, rng.choice(("8.00", "nil"))))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc long, page long, line long, left double, right double, text string")
    together = frame.repartition(3, "doc").sortWithinPartitions("doc", "page")

    def found(given, **how):
        read = tables.read_lines(given, **how)
        return [sorted(map(str, f.collect())) for f in (read, tables.bill_rows(read), tables.bill_notes(read), tables.bill_fields(read, how.get("together", False)))]

    whole = found(frame)
    assert len(whole[1]) > 40 and len(whole[2]) > 5 and any("billing.total" in f and "Sub Total" in f for f in whole[3])
    monkeypatch.setattr(tables, "AT_ONCE", 1)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(frame) == whole and found(together, together=True) == whole
        for of, kinds in ((1, ("row",)), (2, ("note",)), (3, ("row", "total"))):
            assert found(together, together=True, kinds=kinds)[of] == whole[of]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
