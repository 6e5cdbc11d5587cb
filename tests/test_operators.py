"""Operators on literal rows: ties, absences, replays."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import values as V
from dossier.operators import folds, ranking, state


def test_vote_counts_only_eligible_sources(spark):
    rows = [(1, "a", 3, False, 0.9), (1, "a", 1, True, 0.5), (1, "b", 3, True, 0.4), (2, "x", 3, False, 0.9), (3, "p", 1, True, 0.9), (3, "q", 1, True, 0.9)]
    df = spark.createDataFrame(rows, "claim long, normal string, weight int, eligible boolean, confidence double")
    voted = {(r.claim, r.normal): r for r in ranking.vote(df, "claim").collect()}
    assert voted[1, "b"].chosen and voted[1, "b"].weight == 3 and voted[1, "a"].weight == 1
    assert not voted[2, "x"].chosen  # nothing eligible: the value competes, the field is absent
    assert voted[3, "p"].chosen and not voted[3, "q"].chosen  # tie by value
    losers = {(r.claim, r.normal) for r in ranking.competing(ranking.vote(df, "claim"), "claim").collect()}
    assert losers == {(1, "a"), (2, "x"), (3, "q")}


def test_wording_ties(spark):
    df = spark.createDataFrame([(1, "B", 1), (1, "A", 3), (2, "Z", 1), (2, "Y", 1)], "claim long, value string, weight int")
    assert {(r.claim, r.value) for r in ranking.wording(df, "claim").collect()} == {(1, "A"), (2, "Y")}


def test_reconcile_is_stable_and_keeps_decisions(spark):
    stored = spark.createDataFrame([("a", "open", 1), ("b", "auto_closed", 2), ("c", "resolved", 1), ("d", "open", 1)], "f string, status string, occurrences long")
    raised = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), ("e",)], "f string")
    now = state.reconcile(stored, raised, "f", F.lit(True))
    got = {r.f: (r.status, r.occurrences, r.change) for r in now.collect()}
    assert got == {"a": ("open", 2, "kept"), "b": ("reopened", 3, "reopened"), "c": ("resolved", 2, "kept"), "d": ("auto_closed", 1, "auto_closed"), "e": ("open", 1, "created")}
    again = {r.f: (r.status, r.occurrences, r.change) for r in state.reconcile(now.drop("change"), raised, "f", F.lit(False)).collect()}
    assert all(c == "kept" for _, _, c in again.values())
    assert {k: v[:2] for k, v in again.items()} == {k: v[:2] for k, v in got.items()}


def test_changes_ignore_removals(spark):
    old = spark.createDataFrame([(1, "x", None), (2, "y", "k")], "id long, a string, b string")
    new = spark.createDataFrame([(1, "z", None), (3, None, "q")], "id long, a string, b string")
    got = {(r.id, r.field, r.before, r.after, r.kind) for r in state.changes(old, new, "id", "a", "b").collect()}
    assert got == {(1, "a", "x", "z", "changed"), (3, "a", None, None, "new"), (3, "b", None, "q", "new")}


def test_readiness_floor_when_nothing_read(spark):
    claims = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "id long, read boolean")
    taken = spark.createDataFrame([(1, 12, True, False), (1, 8, False, True), (3, 8, False, True)], "id long, amount int, missing boolean, attention boolean")
    got = {r.id: (r.score, r.status) for r in state.readiness(claims, taken, "id").collect()}
    assert got == {1: (80, "incomplete"), 2: (0, "incomplete"), 3: (92, "needs_attention"), 4: (100, "ready_for_human_review")}


def test_segments_fold(spark):
    pages = [(1, 1, "bill", True), (1, 2, "bill", False), (1, 3, "other", False), (1, 4, "note", True), (1, 5, "bill", False), (2, 1, "other", False)]
    df = spark.createDataFrame(pages, "file long, page long, type string, named boolean")
    got = [tuple(r) for r in folds.segments(df, "file", "page", "type", "named").orderBy("file", "segment").collect()]
    assert got == [(1, 0, 1, 3, "bill", 1), (1, 1, 4, 5, "note", 1), (2, 0, 1, 1, "other", 0)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=Decimal("-9999999.99"), max_value=Decimal("9999999.99"), places=2), min_size=1, max_size=30))
def test_amounts_survive_formatting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
    assert df.select(V.amount(V.indian(F.col("v"))).alias("back"), "v").filter("back <> v or back is null").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_squash_is_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    once = T.squash(F.col("v"))
    assert df.filter(T.squash(once) != once).count() == 0


def test_a_label_without_a_value_never_takes_the_next_label(spark):
    from dossier.operators.extraction import Spec, fields

    lines = [(1, 1, 0, "Name:    Age: 40", "text", None), (2, 1, 0, "Name:    Asha Rao    Age: 40", "text", None), (3, 1, 0, "Name - Rao, a name | Age: 7", "text", None)]
    rows = spark.createDataFrame(lines, "doc long, page int, line int, text string, source string, ocr_confidence double")
    got = sorted((r.doc, r.key, r.value) for r in fields(spark, rows, [Spec("name", "name", ("name",)), Spec("age", "integer", ("age",))]).collect())
    assert got == [(1, "age", "40"), (2, "age", "40"), (2, "name", "Asha Rao"), (3, "age", "7"), (3, "name", "Rao, a name")]


def test_segments_of_unread_and_renamed_pages(spark):
    pages = [(1, 1, None, None), (1, 2, "bill", True), (1, 3, "bill", True), (1, 4, None, True), (1, 5, "note", None)]
    df = spark.createDataFrame(pages, "file long, page long, type string, named boolean")
    got = [tuple(r) for r in folds.segments(df, "file", "page", "type", "named").orderBy("segment").collect()]
    assert got == [(1, 0, 1, 1, None, 0), (1, 1, 2, 5, "bill", 2)]


def test_lifecycle_is_the_same_whatever_the_chunks(spark):
    moves = {"see": (("open",), "seen"), "close": (("open", "seen"), "closed"), "again": (("closed",), "open")}
    log = [(k, s, ("see", "close", "again", "close", "see")[(k * 7 + s * s) % 5]) for k in range(4) for s in range(23)]
    df = spark.createDataFrame(log, "k long, s long, action string")
    expected = {}
    for k, _, action in sorted(log):
        status, refused, n = expected.get(k, ("open", 0, 0))
        allowed = status in moves[action][0]
        expected[k] = (moves[action][1] if allowed else status, refused + (not allowed), n + 1)
    for chunk in (1, 3, 1000):
        assert {r.k: (r.status, r.refused, r.n_actions) for r in folds.lifecycle(df, "k", ["s"], "action", "open", moves, chunk).collect()} == expected


def test_pages_are_placed_by_the_strongest_evidence(spark):
    rows = [
        # a bill that counts two pages, whatever the second names; then a second bill by its number
        ("a", 1, "bill", True, {"no": "1"}, 1, 2, "first_page"), ("a", 2, "note", True, None, 2, 2, "counter"), ("a", 3, "bill", True, {"no": "2"}, None, None, "identifier_changed"),
        ("a", 4, "bill", True, None, None, None, "same_type"), ("a", 5, "bill", False, None, None, None, "same_type"), ("a", 6, "other", False, {"no": "2"}, None, None, "same_identifier"),
        ("a", 7, "other", False, None, None, None, "ambiguous"), ("a", 8, "note", True, None, None, None, "type_changed"), ("a", 9, "note", False, None, 1, 1, "counter_restarted"),
        # a count that restarts before it is reached is misread
        ("b", 1, "form", True, None, 1, 2, "first_page"), ("b", 2, "form", True, None, 1, 2, "counter"),
        # nothing is known of the only page; identifiers seen on later pages count
        ("c", 1, None, None, None, None, None, "first_page"), ("d", 1, "bill", True, None, None, None, "first_page"), ("d", 2, "bill", False, {"no": "1"}, None, None, "same_type"), ("d", 3, "bill", False, {"no": "9"}, None, None, "identifier_changed"),
    ]
    df = spark.createDataFrame([r[:7] for r in rows], "file string, page int, type string, named boolean, identifiers map<string,string>, at int, total int")
    assert {(r.file, r.page): r.because for r in folds.placements(df).collect()} == {(r[0], r[1]): r[7] for r in rows}
    spans = {(r.file, r.segment): (r.first_page, r.last_page, r.because, r.uncertain) for r in folds.placed_segments(df).collect()}
    assert spans[("a", 0)] == (1, 2, "first_page", False) and spans[("a", 1)] == (3, 7, "identifier_changed", True) and len(spans) == 8
    assert folds.placements(df.limit(0)).count() == 0
