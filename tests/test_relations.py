"""Checklist relations, rules and state comparison on rows by hand; canonical JSON against a plain version."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dossier.operators import changes, checklist, rules

DOCUMENTS = "claim_id long, doc_id string, doc_type string, usable boolean, excluded boolean"
FINDINGS = "claim_id long, finding_id string, rule string, severity string, active boolean, subject string, document_ids array<string>"
NEEDS, RAISED = {"bill": ("invoice",), "note": ("note", "record"), "form": ("form",)}, {"surgery": ("record",)}


def checked(spark, documents, findings, applies=None, n=1):
    claims = spark.createDataFrame([(k,) for k in range(1, n + 1)], "claim_id long")
    rows = checklist.evaluate(claims, spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(findings, FINDINGS), NEEDS, applies or {}, RAISED)
    return {(r.claim_id, r.requirement): (r.status, r.because, r.n_documents, r.n_shadowed, r.n_findings, r.first_finding) for r in rows.collect()}


def test_requirements_and_what_relates_to_them(spark):
    documents = [(1, "a", "invoice", True, False), (1, "b", "record", True, False), (1, "c", "form", False, True), (1, "d", None, True, False), (1, "a2", "invoice", False, True)]
    findings = [
        (1, "f1", "R9", "warning", True, "x", ["a", "a"]),  # names it, but is not serious
        (1, "f2", "R5", "review", True, "y", ["b", "zz"]),
        (1, "f3", "R1", "critical", False, "y", ["b"]),  # closed
        (1, "f4", "R1", "critical", True, "requirement:surgery", []),  # by the type that both ask for
        (1, "f5", "R1", "critical", True, "requirement:unheard", None),
        (1, "f6", "R2", "critical", True, None, ["c"]),  # names an excluded document
    ]
    got = checked(spark, documents, findings)
    assert got[1, "bill"] == ("found", "documents", 1, 1, 1, "f1")
    assert got[1, "note"] == ("review_required", "open_findings", 1, 0, 3, "f4")
    assert got[1, "form"] == ("missing", "shadowed", 0, 1, 0, None)


def test_conditions_and_nothing_at_all(spark):
    got = checked(spark, [], [], {"bill": F.col("claim_id") > 1, "form": F.lit(None).cast("boolean")}, n=2)
    assert got[1, "bill"][:2] == got[1, "form"][:2] == ("not_applicable", "condition")
    assert got[2, "bill"][:2] == got[2, "note"][:2] == ("missing", "absent") and len(got) == 6


def test_a_type_that_most_documents_have(spark):
    documents = [(k % 3, f"d{k}", "invoice", True, False) for k in range(3000)]
    findings = [(k % 3, f"f{k}", "R1", "review", k % 2 == 0, "s", [f"d{k}", f"d{(k + 3) % 3000}"]) for k in range(0, 3000, 7)]
    got = checked(spark, documents, findings, n=2)
    of = [f for f in findings if f[0] == 1]
    assert got[1, "bill"][:3] == ("review_required", "open_findings", 1000) and got[1, "bill"][4] == len(of)


def test_templates(spark):
    rows = spark.createDataFrame([(1, "s", 1, "it's", ["a"]), (2, None, None, None, ["b", "c"])], "claim_id long, subject string, n long, name string, evidence array<string>")
    rule = rules.Rule("R1", "review", "{name} is on {n:page}, {n} in all", "required")
    first, second = rules.build(rows, rule, "claim_id").orderBy("claim_id").collect()
    assert first.wording == "it's is on 1 page, 1 in all" and second.wording == " is on 0 pages,  in all"
    assert len(first.fingerprint) == 64 and first.fingerprint != second.fingerprint
    quoting = rows.withColumn("name", F.lit("a forged signature"))
    assert "forged" in rules.build(quoting, rule, "claim_id").first().wording  # quoting a document is not saying it


@pytest.mark.parametrize("template, evidence", [("looks Forged", "optional"), ("fine", "sometimes"), ("a { brace", "none"), ("fake {name}", "none")])
def test_rules_refused(template, evidence):
    with pytest.raises(ValueError):
        rules.Rule("R1", "review", template, evidence)


def test_evidence_policy(spark):
    rows = spark.createDataFrame([(1, "s", ["a"]), (2, "t", None)], "claim_id long, subject string, evidence array<string>")
    for policy, fits in (("required", "claim_id = 1"), ("none", "claim_id = 2"), ("optional", "true")):
        rule = rules.Rule("R1", "review", "plain", policy)
        assert rules.build(rows.filter(fits), rule, "claim_id").collect()
        if policy != "optional":
            with pytest.raises(PySparkException, match="evidence"):
                rules.build(rows, rule, "claim_id").collect()
    with pytest.raises(ValueError, match="lacks name"):
        rules.build(rows, rules.Rule("R1", "review", "{name}"), "claim_id")


def test_changes_between_states(spark):
    old = [
        (1, "document", "d1", "a.pdf", "bill", False), (1, "document", "gone", "b.pdf", "bill", False), (1, "document", "d3", "c.pdf", "bill", True),
        (1, "finding", "f1", "F", "open", None), (1, "finding", "f2", "G", "auto_closed", None), (1, "checklist", "bill", "Bill", "missing", None),
        (1, "canonical", "name", "Name", None, None), (1, "canonical", "same", "Same", None, None), (1, "question", "q1", "Q", "open", None), (1, "procedure", "p", "Procedure", "knee", None),
    ]
    new = [
        (1, "document", "d1", "a.pdf", "bill", True), (1, "document", "d2", "d.pdf", "note", False), (1, "document", "d3", "c.pdf", "bill", False),
        (1, "finding", "f1", "F", "auto_closed", None), (1, "finding", "f2", "G", "reopened", None), (1, "finding", "f3", "H", "open", None),
        (1, "checklist", "bill", "Bill", "found", None), (1, "checklist", "new", "New", "missing", None), (1, "canonical", "name", "Name", "Asha", None), (1, "canonical", "same", "Same", None, None),
        (1, "question", "q1", "Q", "resolved", None), (1, "question", "q2", "R", "open", None),
        (2, "document", "d9", "z.pdf", "bill", False), (2, "finding", "f9", "Z", "open", None), (2, "question", "q9", "Z", "open", None), (2, "procedure", "p", "Procedure", "hip", None),
    ]
    before, after = (spark.createDataFrame(rows, "claim_id long, kind string, key string, label string, state string, excluded boolean") for rows in (old, new))
    found = changes.diff(before, after)
    got = {(r.claim_id, r.kind, r.key): (r.before, r.after) for r in found.collect()}
    assert got == {
        (1, "document", "d1"): ("in the claim", "excluded as a duplicate"), (1, "document", "d2"): (None, "note"), (1, "finding", "f1"): ("open", "auto_closed"),
        (1, "finding", "f2"): ("auto_closed", "reopened"), (1, "finding", "f3"): (None, "open"), (1, "checklist", "bill"): ("missing", "found"), (1, "canonical", "name"): (None, "Asha"),
        (1, "question", "q1"): ("open", "resolved"), (1, "question", "q2"): (None, "open"), (1, "procedure", "p"): ("knee", None), (2, "document", "d9"): (None, "bill"), (2, "question", "q9"): (None, "open"),
    }
    one, two = (r.asDict() for r in changes.summary(found, after).orderBy("claim_id").collect())
    assert one == {"claim_id": 1, "changes": 10, "documents_added": 1, "findings_opened": 2, "findings_auto_closed": 1, "questions_asked": 1, "questions_resolved": 1, "checklist_changed": 1, "canonical_changed": 1, "outstanding_requirements": 1}
    assert two["changes"] == 2 and two["findings_opened"] == 0 and two["outstanding_requirements"] == 0
    assert changes.diff(after, after).count() == 0 and changes.diff(before.limit(0), after.limit(0)).count() == 0


def plain(value, ordered=False):
    if isinstance(value, dict):
        return "{" + ",".join(sorted(json.dumps(str(k), ensure_ascii=False) + ":" + plain(v, ordered) for k, v in value.items())) + "}"
    if isinstance(value, list):
        parts = [plain(v, ordered) for v in value]
        return "[" + ",".join(parts if ordered else sorted(parts)) + "]"
    return json.dumps(value, ensure_ascii=False)


NESTED = "id long, state struct<b: array<struct<y: string, x: array<long>>>, a: map<string, array<string>>, c: boolean>"


def test_canonical_json_does_not_depend_on_order(spark):
    rng = random.Random(2)
    state = {"b": [{"y": 'q"uo\\te]', "x": [3, 1, None]}, {"y": None, "x": None}, {"y": "ü\n", "x": []}], "a": {"k]": ["z", None, "a"], "j": None, "": []}, "c": None}

    def mixed():
        rows = [{"y": d["y"], "x": d["x"] and rng.sample(d["x"], len(d["x"]))} for d in rng.sample(state["b"], 3)]
        return {"b": rows, "a": dict(rng.sample(list(state["a"].items()), 3)), "c": None}

    rows = spark.createDataFrame([(k, mixed()) for k in range(6)] + [(6, {**state, "c": True}), (7, None)], NESTED)
    kind = rows.schema["state"].dataType
    got = [r.j for r in rows.orderBy("id").select(changes.canonical_json(F.col("state"), kind).alias("j")).collect()]
    assert set(got[:6]) == {plain(state)} and got[6] == plain({**state, "c": True}) and got[7] == "null"
    digests = [r.d for r in rows.orderBy("id").select(changes.digest(rows, "state").alias("d")).collect()]
    assert len(set(digests[:6])) == 1 and len(set(digests)) == 3
    in_order = rows.filter("id = 6").select(changes.canonical_json(F.col("state"), kind, ordered=True).alias("j")).first().j
    assert in_order == plain({**state, "c": True}, ordered=True) != got[6]
