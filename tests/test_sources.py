"""File sources, sinks and streams."""

import hashlib
import json

from pyspark.sql import functions as F

from dossier.sources import files, sinks
from dossier.streaming.events import event_stream, run


def test_fixtures_and_confidence(spark, tmp_path):
    lines = [{"text": "a", "bbox": [0, 0, 1, 1], "confidence": 0.91}, {"text": "b", "bbox": [0, 0, 1, 1], "confidence": 0.8}]
    (tmp_path / "x.json").write_text(json.dumps({"document": "d", "document_sha256": "x", "engine": "e", "pages": [{"page": 1, "lines": lines}, {"page": 2, "lines": []}]}))
    rows = files.fixtures(spark, str(tmp_path))
    assert [(r.page, r.line, r.text) for r in rows.orderBy("line").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert [tuple(r) for r in files.page_confidence(rows).collect()] == [("x", 1, 0.855, 0.8)]


def test_uploads_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"junk%PDF-1.7"), ("b.png", b"\x89PNG\r\n\x1a\n.."), ("c.txt", b"\xff\xd8\xff.."), ("d.pdf", b"x"), ("e.txt", b"%PDF-")):
        (tmp_path / "in" / name).write_bytes(data)
    have = files.uploads(spark, str(tmp_path / "in"))
    assert {r.name: r.kind for r in have.collect()} == {"a.pdf": "application/pdf", "b.png": "image/png", "c.txt": "image/jpeg", "d.pdf": "unknown", "e.txt": "application/pdf"}
    assert {(r.name, r.problem) for r in files.problems(have, most_files=4).collect()} == {("c.txt", "extension differs"), ("d.pdf", "unknown kind"), ("e.txt", "extension differs"), ("*", "too many files")}
    entry = lambda n, p, h: {"filename": n, "path": p, "label": n, "sha256": h}
    good = hashlib.sha256(b"junk%PDF-1.7").hexdigest()
    (tmp_path / "m.json").write_text(json.dumps({"files": [entry("a.pdf", "x/a.pdf", good), entry("b.png", "b.png", "0"), entry("z.pdf", "z.pdf", "0"), entry("c.txt", "../c.txt", "0")]}))
    got = files.verified(files.manifest(spark, str(tmp_path / "m.json")), have)
    assert {r.filename: r.state for r in got.collect()} == {"a.pdf": "present", "b.png": "changed", "z.pdf": "missing", "c.txt": "refused"}


def test_sinks(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc long, v string")
    path = str(tmp_path / "r")
    sinks.replace(frame([(1, "a"), (1, "b"), (2, "c")]), path, "doc")
    sinks.replace(frame([(1, "z")]), path, "doc")
    assert {(r.doc, r.v) for r in spark.read.parquet(path).collect()} == {(1, "z"), (2, "c")}
    path = str(tmp_path / "s")
    assert sinks.snapshots(spark, frame([(1, "a"), (2, "b")]), path, "doc", "v").count() == 2
    assert [tuple(r)[:2] for r in sinks.snapshots(spark, frame([(1, "a"), (2, "x")]), path, "doc", "v").collect()] == [(2, 2)]
    assert sinks.snapshots(spark, frame([(1, "a"), (2, "x")]), path, "doc", "v").count() == 0
    assert {(r.doc, r.v) for r in sinks.current(spark, path, "doc").collect()} == {(1, "a"), (2, "x")}
    path = str(tmp_path / "e")
    sinks.append(spark.createDataFrame([("m" * 600,)], "message string"), path)
    assert spark.read.parquet(path).select(F.length("message")).first()[0] == 500


def test_stream_equals_batch(spark, sf):
    path = f"{sf}/events.parquet"
    got = run(event_stream(spark, path).filter("event_type = 'error'").select("event_id"), spark, "append", "copy")
    assert got.count() == spark.read.parquet(path).filter("event_type = 'error'").count()
