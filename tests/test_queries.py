"""Every registered query against its oracle, on the smallest tables."""

import pytest

from dossier.plans import registry
from tests.oracle import same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLES:
        same(spark, QUERIES[name], ORACLES[name], sf)
    else:
        assert len(QUERIES[name](spark, sf).schema) > 0
        QUERIES[name](spark, sf).collect()


def test_running_twice_gives_the_same(spark, sf):
    for name in ("canonical_vote", "check_payload", "report_payload"):
        first, second = (sorted(map(str, QUERIES[name](spark, sf).collect())) for _ in range(2))
        assert first == second


def test_entry_registers_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pushdown(spark, sf, capsys):
    QUERIES["owner_scope"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(o_custkey,7)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]
