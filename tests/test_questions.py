"""The life of questions: rules on single events, and a stream of shuffled files against the sorted log."""

import datetime
import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from dossier.streaming import questions
from dossier.streaming.events import event_stream, run
from dossier.streaming.ordered import InOrder

SCHEMA = "claim long, event_id long, ts timestamp, action string, requirement string, expected string, response string, reason string, document string, doc_type string"


def after(*events):
    state = {}
    for e in events:
        state = questions.step(state, {"requirement": "consent", **e})
    return questions.rows(state)[0] if state else None


def test_rules():
    ask = {"action": "ask", "expected": "form|letter"}
    yes = {"action": "answer", "response": "yes"}
    assert after(yes) is None and after(ask)["status"] == "open" and after(ask, yes)["status"] == "answered"
    none = {"action": "answer", "response": "not_available"}
    assert (after(ask, none)["status"], after(ask, none)["n_refused"]) == ("open", 1)  # a reason is needed
    assert after(ask, {**none, "reason": " lost "}) == {"requirement": "consent", "status": "documented_unavailable", "reason": "lost", "document": None, "matched": None, "n_refused": 0, "n_mismatched": 0}
    wrong, right = {"action": "upload", "document": "d1", "doc_type": "bill"}, {"action": "upload", "document": "d2", "doc_type": "letter"}
    assert (after(ask, wrong)["status"], after(ask, wrong)["matched"], after(ask, wrong)["n_mismatched"]) == ("answered", False, 1)
    assert after(ask, wrong, right)["status"] == after(ask, {**none, "reason": "x"}, right)["status"] == "resolved"
    assert after(ask, right, yes)["n_refused"] == 1 and after(ask, right, {"action": "withdraw"})["status"] == "resolved"
    assert after(ask, {"action": "withdraw", "reason": "other claim"})["status"] == "not_applicable"
    assert after(ask, right, ask)["status"] == "resolved" and after(ask, {"action": "answer", "response": "maybe"})["n_refused"] == 1


def test_shuffled_arrival_gives_the_sorted_result(spark, tmp_path):
    rng, begin = random.Random(6), datetime.datetime(2024, 1, 1)
    log = []
    for k in range(400):
        action = rng.choice(("ask", "answer", "upload", "withdraw", "answer"))
        log.append((k % 7, k, begin + datetime.timedelta(minutes=k // 3), action, rng.choice("ab"), "form|letter", rng.choice(("yes", "not_available", "not_applicable")), rng.choice(("why", "", None)), f"d{k}", rng.choice(("form", "bill"))))
    path, state = str(tmp_path / "events.parquet"), str(tmp_path / "state")
    # files hold 40 events each, which come up to 12 minutes out of order
    shuffled = sorted(log, key=lambda e: e[1] + rng.uniform(0, 36))
    for at in range(0, 400, 40):
        spark.createDataFrame(shuffled[at : at + 40], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: questions.question_states(event_stream(spark, path, files=1), "30 minutes")
    run(stream(), spark, "update", "questions", state)
    # the end of the log is applied once time has gone on; the stream goes on from its state
    spark.createDataFrame([(99, 999, begin + datetime.timedelta(days=1), "ask", "z", "", None, None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    found = run(stream(), spark, "update", "questions", state)
    last = found.groupBy("claim", "requirement").agg(F.max_by(F.struct("status", "n_refused", "n_mismatched", "document"), "version").alias("r")).collect()
    states = {}
    for e in sorted(log, key=lambda e: (e[2], e[1])):
        states[e[0]] = questions.step(states.get(e[0], {}), dict(zip(SCHEMA.replace(" long", "").replace(" string", "").replace(" timestamp", "").split(", "), e, strict=True)))
    expected = {(c, r["requirement"]): (r["status"], r["n_refused"], r["n_mismatched"], r["document"]) for c, s in states.items() for r in questions.rows(s)}
    assert {(r.claim, r.requirement): tuple(r.r) for r in last} == expected


class Handle:
    """A key's state and timers, which counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls, self.now = None, [], 0, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_a_key_asks_its_state_as_often_whatever_its_events(spark):
    handle = Handle()
    keyed = InOrder(lambda state, e: {"seen": [*state.get("seen", []), e["n"]]}, lambda state: [{"seen": state["seen"]}], "k", ["k", "seen"])
    keyed.init(handle)
    arrive = lambda *at: list(keyed.handleInputRows((1,), iter([Row(event=json.dumps([t, n, {"n": n}])) for n, t in enumerate(at)]), handle))
    assert arrive(*range(1000, 0, -1)) == [] and handle.timers == [1] and handle.calls == 3
    handle.now = 600
    handle.timers.remove(1)
    assert [r.seen for r in keyed.handleExpiredTimer((1,), handle, None)] == [list(range(999, 399, -1))]
    assert handle.timers == [601] and handle.calls == 6
    assert arrive(2000) == [] and handle.timers == [601] and arrive(600, 650) == [] and handle.timers == [600]
    handle.now = 5000
    handle.timers.clear()
    assert [len(r.seen) for r in keyed.handleExpiredTimer((1,), handle, None)] == [1003] and handle.timers == [] and handle.value[:2] == (None, "")
