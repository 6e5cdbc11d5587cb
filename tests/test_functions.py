"""Scalar functions on literal values."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import values as V

WORKS = {"stone_bridge": r"\bstone bridge\b", "bridge": r"\bbridge\b", "tunnel": r"\btunnel\b"}
IMPLIED = {"stone_bridge": ("bridge",)}
INTENTS = {"missing": ("missing", "absent"), "findings": ("finding", "wrong"), "score": ("score", "ready"), "changes": ("changed", "new")}

#: name -> (function, inputs, expected)
CASES: dict[str, tuple] = {
    "parse_dates": (lambda c: V.date_of(c).cast("string"), [
        ("dated 05-03-2024.", "2024-03-05"), ("5/3/2024", "2024-03-05"), ("05.03.2024", "2024-03-05"), ("5 - Mar - 2024", "2024-03-05"), ("5 march 2024", "2024-03-05"),
        ("2024-03-05", "2024-03-05"), ("31-02-2024", None), ("no date", None), (None, None), ("", None), ("13/13/2024", None),
    ]),
    "parse_amounts": (lambda c: V.amount(c).cast("string"), [
        ("Rs. 1,14,360.00 only", "114360.00"), ("-500", "-500.00"), ("(1,200.50)", "-1200.50"), ("₹ 75", "75.00"), ("INR 12.5", "12.50"), ("none", None), ("", None), (None, None), ("0", "0.00"),
    ]),
    "indian_format": (lambda c: V.indian(c.try_cast(V.MONEY)), [
        ("114360", "1,14,360.00"), ("999", "999.00"), ("1000", "1,000.00"), ("-12345678.9", "-1,23,45,678.90"), ("0", "0.00"), (None, None), ("100000", "1,00,000.00"),
    ]),
    "is_amount": (lambda c: V.is_amount(c).cast("string"), [("1,200.50", "true"), ("(300)", "true"), ("12a", "false"), ("", "false"), (None, "false")]),
    "half_even": (lambda c: V.cents(c.try_cast("decimal(18,4)")).cast("string"), [("2.345", "2.34"), ("2.355", "2.36"), ("-2.345", "-2.34"), ("x", None)]),
    "person_key": (lambda c: T.person_key(c), [
        ("Dr. Anil Rao, MS (Surgery) · Reg. AB-1", "anil rao"), ("Smt Asha  Devi (wife)", "asha devi"), ("MR. J. K. Sen, MD", "j k sen"), ("", ""), (None, ""), ("Lee", "lee"),
    ]),
    "genders": (lambda c: T.gender(c), [("47/M", "male"), ("Female", "female"), ("F, 30 yrs", "female"), ("other", "other"), ("unknown", None), (None, None)]),
    "ages": (lambda c: V.age(c).cast("string"), [("47 yrs", "47"), ("47/M", "47"), ("129", "129"), ("130", None), ("0 y", None), ("born", None), (None, None)]),
    "icd_extract": (lambda c: T.icd10(c), [("acute (K81.0)", "K81.0"), ("icd-10: j18", "J18"), ("U07.1", None), ("none", None), (None, None)]),
    "icd_strip": (lambda c: T.without_icd10(c), [("Acute cholecystitis (ICD-10: K81.0)", "Acute cholecystitis"), ("K81.0", "K81.0"), ("", None), (None, None)]),
    "first_patterns": (lambda c: F.array_join(T.first_patterns(c, WORKS, IMPLIED), ","), [
        ("A stone  bridge, done", "stone_bridge"), ("the bridge", "bridge"), ("abridged", ""), ("Tunnel and bridge", "bridge,tunnel"), (None, ""),
    ]),
    "clean_text": (lambda c: T.clean(T.nfc(c)), [("  a \t b ,;", "a b"), ("cafe\u0301.", "café"), ("", ""), (None, ""), ("x –", "x")]),
    "squashed": (lambda c: T.squash(c), [("A.B--c  D!", "a b c d"), ("é", ""), (None, "")]),
    "name_lists": (lambda c: T.names(F.split(c, ";")), [("b;a;b", "a and b"), ("c;a;b", "a, b and c"), ("x", "x"), (None, None)]),
    "plurals": (lambda c: T.plural(c.try_cast("int"), "entry", "entries"), [("1", "1 entry"), ("0", "0 entries"), ("7", "7 entries"), (None, None)]),
    "file_names": (lambda c: T.file_name(c, 12), [("/a/b/report.pdf", "report.pdf"), ("c:\\x\\averyveryverylongname.pdf", "averyver.pdf"), ("a\u202eb.png", "ab.png"), (None, "")]),
    "emails": (lambda c: T.email(c), [(" A.B@Example.org ", "a.b@example.org"), ("no at", None), ("a@b", None), (None, None)]),
    "snippets": (lambda c: T.snippet(c, F.lit(30), F.lit(35)), [("0123456789" * 8, ("0123456789" * 8)[2:63]), ("Name:  X   Age: 4" + " " * 20 + "end", "me: · X · Age: 4 · end"), (None, None)]),
    "scrubs": (lambda c: T.scrub(c, ["fraud", "guilty"]), [("All fine. This is fraud! Done?", "All fine. Done?"), ("", ""), (None, "")]),
    "intents": (lambda c: T.intent(c, INTENTS), [("What is missing?", "missing"), ("any new finding", "findings"), ("Is it READY", "score"), ("hello", "unknown"), (None, "unknown")]),
    "comparison_forms": (lambda c: V.comparison(F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2))), [
        ("name|Dr. A. Rao", "a rao"), ("id|AB-12 / 3", "ab123"), ("date|05-03-2024", "2024-03-05"), ("gender|M", "male"), ("integer|47 yrs", "47"), ("integer|4x", None),
        ("amount|Rs 2.5", "2.50"), ("diagnosis|Flu (J10.1)", "flu"), ("text|A, b", "a b"), ("date|soon", None),
    ]),
}



@pytest.mark.parametrize("name", sorted(CASES))
def test_function(spark, name):
    function, cases = CASES[name]
    rows = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k bigint, v string")
    assert [r[0] for r in rows.orderBy("k").select(function(F.col("v"))).collect()] == [e for _, e in cases]


def test_a_date_is_read_by_one_pattern(spark, capsys):
    """No function over arrays of words, which Spark interprets and worked out again for each use of its result."""
    rows = [("on 3, 14 2020 and 5/jan_2021", None), ("x 5/jan_2021", "2021-01-05"), ("14 2020 12 05 x", "2020-12-05"), ("7 marchmadn 1999", "1999-03-07"), ("7 marchmadness 1999", None), ("1.2.20201", None), ("31/02/2020", None), ("", None), (None, None)]
    read = spark.createDataFrame(rows, "v string, day string").select("v", "day", V.date_of(F.col("v")).cast("string").alias("got"))
    assert all(r.got == r.day for r in read.collect())
    read.explain(True)
    assert "lambda" not in capsys.readouterr().out
