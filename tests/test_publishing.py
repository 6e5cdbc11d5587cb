"""Writers that meet, all-or-nothing uploads, re-analysis of changed keys only."""

import threading

import pytest
from pyspark.sql import functions as F

from dossier.operators import reanalysis
from dossier.sources import files
from dossier.sources.publish import Conflict, Published, Refused, ingest


def rows(spark, **payloads):
    return spark.createDataFrame(list(payloads.items()), "k string, v string")


def seen(store, upto=None):
    return {r.k: (r.v, r.version) for r in store.current(upto).collect()}


def test_versions(spark, tmp_path):
    store = Published(spark, str(tmp_path / "t"), "k", "v")
    assert seen(store) == {}
    assert store.publish(rows(spark, a="1", b="2")) == 1
    assert store.publish(rows(spark, a="1", b="2")) is None  # nothing differs, nothing is written
    assert store.publish(rows(spark, b="3", c="4")) == 2
    assert seen(store) == {"a": ("1", 1), "b": ("3", 2), "c": ("4", 2)} and seen(store, 1) == {"a": ("1", 1), "b": ("2", 1)}
    assert store.publish(spark.createDataFrame([("a", None), ("x", None)], "k string, v string")) == 3  # taken away
    assert set(seen(store)) == {"b", "c"} and store.publish(rows(spark, a="1")) == 4


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    meet = threading.Barrier(2)
    first = {"x": True, "y": True}
    out, errors = {}, []

    def write(name):
        def wait():
            if first.pop(name, None):
                meet.wait(60)  # both have written their data before either commits

        try:
            out[name] = Published(spark, path, "k", "v").publish(rows(spark, **{name: "own", "both": name}), before_commit=wait)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert not errors and sorted(out.values()) == [1, 2]
    found = seen(Published(spark, path, "k", "v"))
    last = max(out, key=out.get)
    assert found["x"][0] == found["y"][0] == "own" and found["both"] == (last, 2)


def test_a_writer_gives_up_and_leaves_nothing(spark, tmp_path):
    store = Published(spark, str(tmp_path / "t"), "k", "v")
    other = Published(spark, str(tmp_path / "t"), "k", "v")
    turn = iter(range(10))
    with pytest.raises(Conflict):
        store.publish(rows(spark, a="1"), before_commit=lambda: other.publish(rows(spark, z=str(next(turn)))))
    assert set(seen(store)) == {"z"} and len(store.commits()) == 2 == len(list((tmp_path / "t" / "data").iterdir()))
    assert not store.commit(1, "late") and len(store.commits()) == 2


def test_uploads_all_or_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (folder / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    store = Published(spark, str(tmp_path / "t"), "path", "payload")
    assert ingest(store, files.uploads(spark, str(folder)), 50, 1000) == 1 and store.current().count() == 2
    (folder / "c.png").write_bytes(b"\xff\xd8\xff\xe0")  # a JPEG that calls itself PNG
    (folder / "d.JPG").write_bytes(b"\xff\xd8\xff\xe0")
    (folder / "e.pdf").write_bytes(b"")
    with pytest.raises(Refused) as e:
        ingest(store, files.uploads(spark, str(folder)), 50, 1000)
    assert sorted(e.value.reasons) == [("c.png", "extension differs"), ("e.pdf", "empty"), ("e.pdf", "unknown kind")] and store.current().count() == 2
    with pytest.raises(Refused):
        ingest(store, files.uploads(spark, str(folder)).filter("name = 'a.pdf'"), 0, 1000)


def test_only_changed_keys_are_computed(spark, tmp_path):
    store, given = Published(spark, str(tmp_path / "t"), "k", "v"), []

    def analyse(inputs):
        given.append({r.k for r in inputs.select("k").distinct().collect()})
        return inputs.groupBy("k").agg(F.sum("n").alias("s"), F.max("t").alias("t"))

    def run(data):
        version = reanalysis.refresh(spark.createDataFrame(data, "k long, n long, t string").repartition(3), store, analyse)
        return version, {int(r.k): (r.s, r.t) for r in reanalysis.result(store, "s bigint, t string").collect()}

    assert run([(1, 1, "a"), (1, 2, None), (2, 5, "b"), (3, 7, None)]) == (1, {1: (3, "a"), 2: (5, "b"), 3: (7, None)})
    assert run([(3, 7, None), (1, 2, None), (2, 5, "b"), (1, 1, "a")])[0] is None  # another order
    assert run([(1, 1, "a"), (1, 2, "z"), (2, 5, "b"), (4, 1, None)]) == (2, {1: (3, "z"), 2: (5, "b"), 4: (1, None)})
    assert given == [{1, 2, 3}, set(), {1, 4}]
    assert run([]) == (3, {})


def test_inputs_are_dealt_out_by_key_once(spark, tmp_path):
    store, plans = Published(spark, str(tmp_path / "t"), "k", "v"), []

    def analyse(inputs):
        found = inputs.groupBy("k").agg(F.sum("n").alias("s"))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    spark.range(100).selectExpr("id % 9 AS k", "id AS n").write.parquet(str(tmp_path / "in"))
    inputs = spark.read.parquet(str(tmp_path / "in"))
    with_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert reanalysis.refresh(inputs.filter("n < 90"), store, analyse) == 1 and reanalysis.refresh(inputs, store, analyse) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_broadcast)
    # the inputs for their fingerprints and for the analysis, and what was seen: nothing is dealt out again to meet or to be grouped
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 3]
    assert {int(r.k): r.s for r in reanalysis.result(store, "s bigint").collect()} == {k: sum(range(k, 100, 9)) for k in range(9)}


def test_rows_known_to_differ_are_compared_again_after_another_writer(spark, tmp_path):
    store, other = (Published(spark, str(tmp_path / "t"), "k", "v") for _ in range(2))
    assert store.publish(rows(spark, a="1", b="2"), differs_from=0) == 1
    first = iter([True])
    version = store.publish(rows(spark, a="3", b="4"), before_commit=lambda: next(first, False) and other.publish(rows(spark, a="3")), differs_from=1)
    assert version == 3 and seen(store) == {"a": ("3", 2), "b": ("4", 3)}
