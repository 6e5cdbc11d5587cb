"""The life of the questions of a claim: asked, answered, answered by an upload, withdrawn.

Events of a claim: ``ask`` (requirement, expected types), ``answer`` (response, reason), ``upload`` (document, its type),
``withdraw`` (reason).  A question is open until it is answered; "yes" does not settle it, a document of an expected type
does.  What a question no longer allows is refused and counted, never applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from dossier.streaming.ordered import in_event_order

PENDING = ("open", "answered")
#: response -> (status it leads to, whether it needs a reason)
RESPONSES = {"yes": ("answered", False), "not_available": ("documented_unavailable", True), "not_applicable": ("not_applicable", True)}
SCHEMA = "claim bigint, requirement string, status string, reason string, document string, matched boolean, n_refused bigint, n_mismatched bigint"


def step(state: dict, event: dict) -> dict:
    """A claim's questions after one more event."""
    name, action = event.get("requirement"), event.get("action")
    q = state.get(name)
    if action == "ask":
        if q is None:
            state[name] = {"status": "open", "expected": (event.get("expected") or "").split("|"), "refused": 0, "mismatched": 0}
        return state
    if q is None:
        return state  # nothing was asked
    reason = (event.get("reason") or "").strip()
    if action == "upload":
        # a document is looked at whatever the question's status, and settles it unless it is settled
        q["document"], q["matched"] = event.get("document"), event.get("doc_type") in q["expected"]
        q["mismatched"] += not q["matched"]
        if q["matched"] and q["status"] in (*PENDING, "documented_unavailable"):
            q["status"] = "resolved"
        elif q["status"] == "open":
            q["status"] = "answered"
    elif action == "withdraw" and q["status"] in PENDING:
        q["status"], q["reason"] = "not_applicable", reason[:500]
    elif action == "answer" and q["status"] in PENDING and event.get("response") in RESPONSES:
        status, needs_reason = RESPONSES[event["response"]]
        if needs_reason and not reason:
            q["refused"] += 1
        else:
            q["status"], q["reason"] = status, reason[:500]
    else:
        q["refused"] += 1
    return state


def rows(state: dict) -> list[dict]:
    return [
        {"requirement": name, "status": q["status"], "reason": q.get("reason") or None, "document": q.get("document"), "matched": q.get("matched"), "n_refused": q["refused"], "n_mismatched": q["mismatched"]}
        for name, q in sorted(state.items())
    ]


def question_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Questions of each claim whenever they change; ``events``: claim, event_id, ts and the fields that ``step`` reads."""
    return in_event_order(events, "claim", "event_id", step, rows, SCHEMA, late)
