"""Files, sinks and constraint tables."""

import json

import pytest
from pyspark.sql import functions as F

from citeloom.functions.checks import ConstraintError, require_none, violations
from citeloom.operators import ingest
from citeloom.sources import files, tables


def test_load_sources_and_failures(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("﻿# Title here\r\n\r\nBody".encode())
    (tmp_path / "b.TXT").write_text("plain text")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "d.txt").write_text("  \n")
    (tmp_path / "e.pdf").write_text("no")
    (tmp_path / "f.txt").write_text("x" * 500)
    (tmp_path / "sub" / "g.html").write_text("<p>Hello</p>")
    docs, failures = files.load_sources(spark, str(tmp_path), recursive=True, max_bytes=400)
    got = {r.source_uri: r for r in docs.collect()}
    assert got["file://data/raw/a.md"].title == "Title here" and got["file://data/raw/a.md"].text == "# Title here\n\nBody"
    assert got["file://data/raw/b.TXT"].title == "b" and got["file://data/raw/sub/g.html"].text == "Hello"
    assert {(r.source_uri.rsplit("/", 1)[1], r.code) for r in failures.collect()} == {("c.txt", "invalid_encoding"), ("d.txt", "empty_source"), ("f.txt", "source_too_large")}
    assert files.discover(spark, str(tmp_path)).count() == 5


def test_documents_are_written_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    one = spark.createDataFrame([("d1", "x"), ("d2", "y")], "document_id string, text string")
    assert {r.disposition for r in tables.write_documents(one, path, batch="1").collect()} == {"created"}
    assert tables.write_documents(one, path, batch="2").count() == 0
    changed = spark.createDataFrame([("d1", "z")], "document_id string, text string")
    with pytest.raises(tables.ConflictError):
        tables.write_documents(changed, path, batch="3")
    assert [r.disposition for r in tables.write_documents(changed, path, batch="4", overwrite=True).collect()] == ["overwritten"]
    assert {(r.document_id, r.text) for r in tables.read_documents(spark, path).collect()} == {("d1", "z"), ("d2", "y")}


def test_runs_and_reports_are_not_replaced(spark, tmp_path):
    run = spark.createDataFrame([("r1", 2)], "run_id string, document_count int")
    tables.append_run(run, str(tmp_path / "runs"))
    with pytest.raises(tables.ConflictError):
        tables.append_run(run, str(tmp_path / "runs"))
    tables.write_report(run, str(tmp_path / "report"))
    with pytest.raises(Exception):
        tables.write_report(run, str(tmp_path / "report"))


def test_json_inputs(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "1", "question": "q", "split": "dev", "gold_chunk_ids": ["c"], "fact_family_id": "f"}]))
    (tmp_path / "c.jsonl").write_text('{"case_id": "k", "query": "q", "allow_external_query": true}\n')
    assert files.read_samples(spark, str(tmp_path / "s.json")).head().gold_chunk_ids == ["c"]
    assert files.read_cases(spark, str(tmp_path / "c.jsonl")).head().allow_external_query is True


def test_constraints_are_rows_or_errors(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, n int")
    found = violations(df, F.col("id"), {"negative": F.col("n") < 0, "missing": F.col("n").isNull()})
    assert {(r.entity_id, r.rule) for r in found.collect()} == {("2", "negative"), ("3", "missing")}
    with pytest.raises(ConstraintError):
        require_none(found, "bad rows")


def test_dispositions(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "document_id string, payload_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "9")], "document_id string, payload_hash string")
    assert {r.document_id: r.disposition for r in ingest.dispositions(new, old).collect()} == {"a": "unchanged", "b": "conflict", "c": "created"}


def test_paths_stay_inside_the_root(spark):
    rows = ["a.txt", "sub/../a.txt", "../raw/a.txt", "../other/a.txt", "/data/raw/a.txt", "/data/rawer/a.txt", "file:/data/raw//./a.txt", "a/../../../../../x.txt", "gone.txt", "b.pdf", "..", "", None]
    asked = spark.createDataFrame([(p,) for p in rows], "path string")
    listing = spark.createDataFrame([("file:///data/raw/a.txt",), ("file:///data/raw/b.pdf",)], "path string")
    good, bad = files.guarded_paths(asked, listing, "/data/raw")
    assert sorted(r.path for r in good.collect()) == sorted(["a.txt", "sub/../a.txt", "../raw/a.txt", "/data/raw/a.txt", "file:/data/raw//./a.txt"])
    assert {r.resolved for r in good.collect()} == {"/data/raw/a.txt"}
    assert {r.path: r.code for r in bad.collect()} == {
        "../other/a.txt": "outside_root", "/data/rawer/a.txt": "outside_root", "a/../../../../../x.txt": "outside_root", "..": "outside_root", "": "outside_root",
        None: "outside_root", "gone.txt": "missing", "b.pdf": "unsupported_source"}


def test_a_folder_outside_the_allowed_root_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x y")
    assert files.load_sources(spark, str(tmp_path / "in"), allowed_root=str(tmp_path))[0].count() == 1
    for root in (str(tmp_path / "in" / ".." / ".."), str(tmp_path) + "-other"):
        with pytest.raises(ValueError):
            files.load_sources(spark, root, allowed_root=str(tmp_path))


def test_artifacts_that_cannot_be_read_are_rows(spark, tmp_path):
    sha = "0" * 64
    doc = {"document_id": "d1", "source_uri": "u", "title": "t", "source_type": "text", "content_sha256": sha, "text": "x", "byte_size": 1}
    lines = [json.dumps(doc), json.dumps(doc | {"document_id": "d2"})[:-7], "no json at all", json.dumps(doc | {"document_id": "d3", "byte_size": -4}), json.dumps(doc | {"document_id": "d4", "byte_size": "many"})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    good, issues = tables.read_artifacts(spark, str(tmp_path / "a.json"))
    assert [r.document_id for r in good.collect()] == ["d1"]
    assert {(r.document_id, r.code, r.detail) for r in issues.collect()} == {
        ("d2", "artifact_invalid", "malformed"), (None, "artifact_invalid", "malformed"), ("d3", "artifact_invalid", "negative_size"), ("d4", "artifact_invalid", "malformed")}
    wanted = spark.createDataFrame([("d1",), ("d2",), ("d9",)], "document_id string")
    good, issues = tables.read_artifacts(spark, str(tmp_path / "a.json"), wanted)
    assert good.count() == 1 and {(r.document_id, r.code) for r in issues.collect()} == {("d2", "artifact_invalid"), ("d9", "artifact_not_found")}
