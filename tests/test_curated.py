"""Curated folders, configurations with includes, discovery outputs, status findings."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.operators import validation
from quillon.sources import curated


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_the_last_file_of_a_source_wins(spark, tmp_path):
    pytest.importorskip("yaml")
    at = tmp_path / "c"
    write(at, a__json='\ufeff{"source_id": "x", "v": "ä"}', b__yaml='{"source_id": "x", "w": [1, 2]}', c__yml="# nothing\n", d__json="{", e__json=b'{"source_id": "\xff"}', f__txt='{"source_id": "x"}', g__json='{"source_id": ""}', h__json="[1]", i__json='{"source_id": "y", "source_id": "z"}')
    write(at / "below", z__json='{"source_id": "deep"}')
    name = F.regexp_extract("path", "([^/]+)$", 1)
    files = curated.folder_files(spark, str(at))
    assert {r.n: r.issue for r in files.select(name.alias("n"), "issue").collect()} == {"a.json": None, "b.yaml": None, "c.yml": None, "d.json": "file.invalid", "e.json": "file.encoding", "g.json": None, "h.json": None, "i.json": "file.invalid"}
    got = [(r.source_id, r.n, json.loads(r.d)) for r in curated.mappings(files).select("source_id", name.alias("n"), F.to_json("document").alias("d")).collect()]
    assert got == [("x", "b.yaml", {"source_id": "x", "w": [1, 2]})]
    found = {(r.record_id.rsplit("/", 1)[1], r.code, r.severity) for r in curated.mapping_findings(files).collect()}
    assert found == {("a.json", "file.replaced", "warning"), ("c.yml", "file.no_source", "warning"), ("d.json", "file.invalid", "error"), ("e.json", "file.encoding", "error"), ("g.json", "file.no_source", "warning"), ("h.json", "file.no_source", "warning"), ("i.json", "file.invalid", "error")}
    assert sorted(r.source_id for r in curated.mappings(curated.folder_files(spark, str(at), deep=True)).collect()) == ["deep", "x"]


def test_yaml_is_read(spark, tmp_path):
    pytest.importorskip("yaml")
    write(tmp_path / "c", a__yaml="source_id: x\nopens: 2026-01-02\nnames:\n  - é\n  - 'no'\n", b__yml="a: [1")
    files = curated.folder_files(spark, str(tmp_path / "c"))
    assert [json.loads(r.d) for r in curated.mappings(files).select(F.to_json("document").alias("d")).collect()] == [{"source_id": "x", "opens": "2026-01-02", "names": ["é", "no"]}]
    assert [r.code for r in curated.mapping_findings(files).collect()] == ["file.invalid"]


def test_an_empty_folder_has_no_mappings(spark, tmp_path):
    (tmp_path / "c").mkdir()
    files = curated.folder_files(spark, str(tmp_path / "c"))
    assert curated.mappings(files).count() == curated.mapping_findings(files).count() == curated.configured(files, F.lit(True)).count() == 0


def test_paths_that_leave_their_folder(spark):
    bad, good = ["", "/a", "\\a", "C:x", "c:\\x", "../a", "a/../b", "a\\..\\b", "..", "a\0b", None], ["a", "a/b", "a..b", "..a/b", "./a", "a\\b"]
    rows = spark.createDataFrame([(p,) for p in bad + good], "p string").select("p", curated.escapes(F.col("p")).alias("e")).collect()
    assert {r.p: r.e for r in rows} == {**dict.fromkeys(bad, True), **dict.fromkeys(good, False)}


def source(name, **changes):
    return {"source_id": name, "name": name, "url": "https://www.Example.org/in/a", "provider": {"id": "p", "name": "P"}, "role": "r", "parser": "x", "allowed_domains": ["example.org", "*.example.org"], "allowed_paths": ["/in/"]} | changes


def test_sources_and_their_findings(spark, tmp_path):
    own = [source("a", language="fr", max_pages=5, notes="n"), source("a"), source("b", url="https://example.org/out"), source("c", url="https://user@example.org/in/"), source("d", access_status="open", max_pages=0)]
    more = [source("a"), {k: v for k, v in source("e").items() if k not in ("role", "provider", "url")}, source("f", allowed_domains=["example.com"]), source("g", url="https://notexample.org/in/"), 7]
    root = {"sources": own, "include": ["more.json", "none.json", "../x.json", "broken.json", "empty.json"]}
    write(tmp_path / "c", root__json=json.dumps(root), more__json=json.dumps({"sources": more, "include": ["root.json"]}), broken__json="{", empty__json="{}", other__json=json.dumps({"sources": [source("never")]}))
    got = curated.configured(curated.folder_files(spark, str(tmp_path / "c")), F.col("path").endswith("/root.json"))
    rows = {(r.file, r.at): r for r in got.collect()}
    every = [f"source.missing:{k}" for k in curated.REQUIRED]
    assert {k: (r.source_id, r.codes) for k, r in rows.items()} == {
        (0, 0): ("a", []), (0, 1): ("a", ["source.duplicate_id"]), (0, 2): ("b", ["source.start_url:not_allowed"]), (0, 3): ("c", ["source.start_url:credentials"]), (0, 4): ("d", ["source.access_status"]),
        (1, 0): ("a", ["source.duplicate_id"]), (1, 1): ("e", [f"source.missing:{k}" for k in ("url", "provider.id", "provider.name", "role")]), (1, 2): ("f", ["source.start_url:not_allowed"]), (1, 3): ("g", ["source.start_url:not_allowed"]), (1, 4): (None, every),
        (2, None): (None, ["include.missing"]), (3, None): (None, ["include.escapes"]), (4, None): (None, ["include.unreadable"]),
    }
    a, d = rows[0, 0], rows[0, 4]
    assert (a.language, a.max_pages, a.notes, a.access_status, a.provider_name, a.allowed_paths) == ("fr", 5, "n", "unreviewed", "P", ["/in/"])
    assert (d.language, d.max_pages, d.notes) == ("en", None, None)


def test_discovery_is_written_by_source(spark, tmp_path):
    entries = spark.createDataFrame([("s/1", i, f"e{i}") for i in range(9, -1, -1)] + [("t", 1, "x")], "source string, id long, name string")
    declared = spark.createDataFrame([("s/1", 16), ("u", 4)], "source string, declared long")
    got = curated.write_discovery(entries, str(tmp_path / "d"), "source", "id", declared)
    assert {tuple(r) for r in got.select("source", "observed", "declared", "coverage").collect()} == {("s/1", 10, 16, 0.625), ("t", 1, None, None), ("u", 0, 4, 0.0)}
    assert sorted(tuple(r) for r in spark.read.schema("source string, id long, name string").json(str(tmp_path / "d" / "entries")).select(*entries.columns).collect()) == sorted(map(tuple, entries.collect()))
    assert spark.read.json(str(tmp_path / "d" / "summary")).count() == 3


RECORD = "r struct<id:string,review_status:string,publication_status:string,extraction_method:string,is_demo:boolean,review:struct<reviewer:string>,last_fetched_at:string,last_verified_at:string>"


@pytest.mark.parametrize(
    "mode, changes, codes",
    [
        ("live", {}, []),
        ("demo", {}, ["mode.live_in_demo:is_demo"]),
        ("live", {"is_demo": True}, ["demo.method_mismatch:is_demo", "demo.id_prefix:id", "mode.demo_in_live:is_demo"]),
        ("demo", {"is_demo": True, "id": "demo_1", "extraction_method": "demo_synthetic"}, []),
        (None, {"extraction_method": "demo_synthetic"}, ["demo.method_mismatch:is_demo"]),
        ("live", {"review_status": "human_reviewed", "review": None}, ["review.record_missing:review"]),
        ("live", {"review_status": "pending"}, ["verification.status_mismatch:last_verified_at", "publication.not_reviewed:publication_status"]),
        ("live", {"extraction_method": "llm"}, ["publication.llm_unreviewed:extraction_method"]),
        ("live", {"extraction_method": "llm", "publication_status": "draft", "review_status": "pending", "last_verified_at": ""}, []),
        ("live", {"last_fetched_at": "1970-01-01T00:21:41Z", "last_verified_at": "1970-01-01T00:21:40Z"}, ["time.in_future:last_fetched_at"]),
    ],
)
def test_status_codes(spark, mode, changes, codes):
    row = {"id": "a", "review_status": "machine_checked", "publication_status": "published", "extraction_method": "adapter", "is_demo": False, "review": {"reviewer": "x"}, "last_fetched_at": None, "last_verified_at": "1970-01-01T00:00:00Z"} | changes
    df = spark.createDataFrame([(row,)], RECORD)
    assert df.select(validation.status_codes(F.col("r"), mode, F.lit(1000)).alias("c")).first().c == codes


def test_files_may_lie_in_a_table(spark):
    rows = [("a.json", b'\xef\xbb\xbf{"source_id": "x"}'), ("b.yaml", b'{"source_id": "x", "w": 1}'), ("c.json", b"{"), ("d.json", b"\xff"), ("e.json", b'{"source_id": ""}'), ("f.yaml", None)]
    files = curated.read_files(spark.createDataFrame(rows, "path string, content binary"))
    assert [(r.source_id, r.path) for r in curated.mappings(files).collect()] == [("x", "b.yaml")]
    assert {(r.record_id, r.code, r.severity) for r in curated.mapping_findings(files).collect()} == {("a.json", "file.replaced", "warning"), ("c.json", "file.invalid", "error"), ("d.json", "file.encoding", "error"), ("e.json", "file.no_source", "warning"), ("f.yaml", "file.encoding", "error")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_written_files_do_not_grow_with_sources(spark, tmp_path, monkeypatch):
    from quillon.plans import curated_queries

    monkeypatch.setattr(curated_queries, "folder", lambda spark: str(tmp_path / "files"))
    assert curated_queries.curated_mappings(spark, "/root/testdata/sf0.01").select("source_id").distinct().count() > 80
    assert len(list((tmp_path / "files").rglob("part-*"))) < 20
