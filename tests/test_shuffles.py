"""Queries over claims deal their rows out once."""

import pytest

from dossier.operators import changes
from dossier.plans import registry

DEALT = "Exchange hashpartitioning"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["run_summary", "check_payload", "finding_order", "charge_once"])
def test_findings_are_reduced_before_they_meet(spark, sf, name):
    found = plan(registry.queries()[name](spark, sf))
    assert "Window" not in found and found.count("Expand") == 0 and found.count("FileScan") == 2


@pytest.mark.parametrize("name, windows", [("named_findings", 2), ("named_checks", 0), ("claim_state", 1)])
def test_lines_are_dealt_out_before_they_become_many_rows(spark, sf, name, windows):
    found = plan(registry.queries()[name](spark, sf))
    assert found.count(f"{DEALT}(l_orderkey") >= 1 and f"{DEALT}(claim_id" + ", field" not in found
    assert sum("Window [" in line for line in found.splitlines()) == windows


def test_states_are_read_once(spark):
    state = lambda n: spark.range(n).selectExpr("id AS claim_id", "'document' AS kind", "'k' AS key", "'l' AS label", "'s' AS state", "false AS excluded")
    found = changes.diff(state(3), state(5))
    assert sum("Range (" in line for line in plan(found).splitlines()) == 2
    assert sorted(r.claim_id for r in found.collect()) == [3, 4]
