"""Layout, extraction, answers and sheets on literal rows."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from dossier.operators import assistant, extraction, layout, report


def test_concealed_words(spark):
    words = spark.createDataFrame([(1, 1, "a", [0.0, 0.0, 0.2, 0.1]), (1, 9, "b", [0.0, 0.0, 0.2, 0.1]), (1, 2, "c", [0.5, 0.5, 0.6, 0.6]), (2, 1, "d", [0.0, 0.0, 0.2, 0.1]), (1, 3, "e", [0.1, 0.1, 0.1, 0.2])], "page int, seq int, text string, box array<double>")
    fills = spark.createDataFrame([(1, 5, [0.0, 0.0, 0.15, 0.1]), (1, 6, [0.55, 0.5, 0.6, 0.6])], "page int, seq int, box array<double>")
    assert [(r.text, r.coverage) for r in layout.concealed(words, fills).collect()] == [("a", 0.75)]


def test_boxes(spark):
    df = spark.createDataFrame([([0.9, -1.0, 0.1234567, 2.0],)], "b array<double>")
    assert df.select(layout.normalised(F.col("b"))).first()[0] == [0.12346, 0.0, 0.9, 1.0]


def test_lines(spark):
    words = [(1, "world", 40.0, 60.0, 11.0), (1, "hello", 10.0, 35.0, 10.0), (1, "far", 100.0, 120.0, 12.0), (1, "next", 10.0, 30.0, 14.0)]
    got = layout.lines(spark.createDataFrame(words, "page long, text string, left double, right double, baseline double")).orderBy("line").collect()
    assert [r.text for r in got] == ["hello world  far", "next"]


def test_slots(spark):
    slots = spark.createDataFrame([(1, "s1", "Doctor", [0.0, 0.0, 0.5, 0.5], True), (1, "s2", "Patient", [0.5, 0.5, 1.0, 1.0], False)], "page int, slot string, caption string, box array<double>, required boolean")
    ink = spark.createDataFrame([(1, [0.1, 0.1, 0.3, 0.3]), (1, [0.3, 0.3, 0.9, 0.6])], "page int, box array<double>")
    assert {r.slot: r.signed for r in layout.signed(slots, ink).collect()} == {"s1": True, "s2": False}
    expected = spark.createDataFrame([(1, 0, "(?i)sign"), (1, 1, "(?i)doctor"), (1, 2, "(?i)sign")], "doc long, place long, pattern string")
    captions = spark.createDataFrame([(1, 0, "Doctor's signature"), (1, 1, "Signature of patient")], "doc long, place long, text string")
    assert {r.place: r.caption for r in layout.match_slots(expected, captions).collect()} == {0: 0, 1: None, 2: 1}


def test_fields(spark):
    rows = [(1, 1, 0, "Patient name: Dr. Asha Rao   Age: 40 yrs", "text", None), (1, 2, 0, "Name: Other", "text", None), (1, 1, 1, "Bill date: soon", "text", None), (1, 3, 0, "| Invoice date - 05-03-2024", "ocr", 0.95)]
    lines = spark.createDataFrame(rows, "doc long, page int, line int, text string, source string, ocr_confidence double")
    specs = [extraction.Spec("name", "name", ("patient name", "name")), extraction.Spec("date", "date", ("bill date", "invoice date"))]
    got = {r.key: r for r in extraction.fields(spark, lines, specs).collect()}
    assert (got["name"].normal, got["name"].page, got["name"].confidence) == ("asha rao", 1, 0.95)
    assert (got["date"].normal, got["date"].confidence) == ("2024-03-05", 0.9)
    assert got["name"].evidence == "Patient name: Dr. Asha Rao · Age: 40 yrs"


def test_bills(spark):
    text = ["S.No  Description  Qty  Rate  Amount", "1  Gauze  2  10.00  20.00", "2.  Drip  1  5.50  5.50", "note", "Sub total  25.50", "Total  25.50", "Total  99.00"]
    lines = spark.createDataFrame([(7, 1, k, t) for k, t in enumerate(text)], "doc long, page int, line long, text string")
    got = [(r.description, r.quantity, r.amount, r.kind) for r in extraction.bills(lines).orderBy("line").collect()]
    assert got == [("Gauze", "2", "20.00", "line"), ("Drip", "1", "5.50", "line"), ("Sub total", None, "25.50", "subtotal"), ("Total", None, "25.50", "total")]


def test_answers_and_guard(spark):
    state = spark.createDataFrame([(1, 88, ["b", "a"], [], ["x"])], "claim_id long, score int, missing array<string>, findings array<string>, documents array<string>")
    asked = spark.createDataFrame([(1, "What is missing?"), (1, "is it ready"), (1, "any problem"), (2, "score")], "claim_id long, question string")
    got = {(r.claim_id, r.intent): r.answer for r in assistant.answer(asked, state).collect()}
    assert got == {(1, "missing"): "2 requirements missing: a, b.", (1, "score"): "The documentation scores 88.", (1, "findings"): "0 open findings.", (2, "score"): "This claim is not known."}
    texts = spark.createDataFrame([(1, "See [doc:1] and [doc:9]. It is fraud!"), (2, "A fake.")], "id long, text string")
    known = spark.createDataFrame([(1, "doc", 1)], "id long, kind string, number int")
    out = {r.id: (r.text, r.unknown) for r in assistant.guarded(texts, known).collect()}
    assert out == {1: ("See [doc:1] and.", ["[doc:9]"]), 2: ("No answer can be given from the documents.", [])}


def test_sheets(spark, tmp_path):
    assert report.sheet_names(["A/B", "AB", "x" * 40, "x" * 40]) == ["AB", "AB 2", "x" * 31, "x" * 29 + " 2"]
    folders = report.write_sheets({"Facts": spark.createDataFrame([("=1+1", 2)], "a string, b int")}, str(tmp_path))
    assert spark.read.option("header", True).csv(folders[0]).first() == Row(a="'=1+1", b="2")
    assert "<td>a &amp; b</td>" in report.page(Row(title="t", score=1, readiness="r", checklist=[{"requirement": "a & b", "state": "found"}]))


def test_lines_equal_a_fold(spark):
    import random

    rng = random.Random(5)
    words = [(p, f"w{k}", x := float(rng.randint(0, 90)), x + rng.randint(1, 9), rng.choice((0.0, 1.0, 2.0, 3.0, 6.0, 20.0))) for p in (1, 2, 7) for k in range(p * 9)]
    frame = spark.createDataFrame(words, "page long, text string, left double, right double, baseline double")
    expected = []
    for page in (1, 2, 7):
        rows = []
        for w in sorted((w for w in words if w[0] == page), key=lambda w: (w[4], w[2], w[1])):
            if not rows or w[4] - rows[-1][0][4] > 2.5:
                rows.append([])
            rows[-1].append(w)
        rows = [sorted(r, key=lambda w: (w[2], w[1])) for r in rows]
        gaps = sorted(b[2] - a[3] for r in rows for a, b in zip(r, r[1:]) if 0 < b[2] - a[3] < 40)
        usual = min(max(2.5 * (gaps[len(gaps) // 2] if gaps else 7.0), 7.0), 16.0)
        for i, r in enumerate(rows):
            expected.append((page, i, r[0][1] + "".join(("  " if b[2] - a[3] > usual else " ") + b[1] for a, b in zip(r, r[1:]))))
    found = layout.lines(frame)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no call of Python for each page
