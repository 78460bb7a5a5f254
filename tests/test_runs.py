"""Stores that streams change batch by batch, and runs."""

import os

from pyspark.sql import functions as F

from quillon.operators import documents, runs
from quillon.streaming import events, store

SCHEMA = "id long, at long, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_upserts_over_batches_with_one_repeated(spark, tmp_path):
    kept = store.Store(spark, f"{tmp_path}/s", SCHEMA, "id", 4)
    step = store.upserts(kept, "at")
    assert kept.read().count() == 0
    assert step(rows(spark, *((i, 1, f"a{i}") for i in range(20))), 0)
    before = {k: set(os.listdir(f"{tmp_path}/s/data/b=0/{k}")) for k in os.listdir(f"{tmp_path}/s/data/b=0") if k.startswith("bucket=")}
    assert step(rows(spark, (3, 2, "new"), (4, 0, "old"), (99, 1, "x")), 1)
    assert not step(rows(spark, (3, 9, "never")), 1) and not step(rows(spark, (3, 9, "never")), 0)
    state = {r.id: r.v for r in kept.read().collect()}
    assert state == {**{i: f"a{i}" for i in range(20)}, 3: "new", 99: "x"}
    held = kept._held()
    assert any(b == 0 for b in held.values()) and any(b == 1 for b in held.values())  # some buckets were not touched
    assert {k: set(os.listdir(f"{tmp_path}/s/data/b=0/{k}")) for k in before} == before  # the commit before still reads
    assert step(rows(spark, *((i, 5, "z") for i in range(20))), 2)
    assert not os.path.exists(f"{tmp_path}/s/data/b=0/bucket={next(k for k, b in held.items() if b == 1)}")  # named by neither of the last two commits
    assert {r.v for r in kept.read().where("id < 20").collect()} == {"z"}


def test_a_batch_that_died_is_written_anew(spark, tmp_path):
    kept = store.Store(spark, f"{tmp_path}/s", SCHEMA, "id", 2)
    step = store.upserts(kept, "at")
    step(rows(spark, (1, 1, "a")), 0)
    rows(spark, (1, 7, "torn")).withColumn("bucket", kept.bucket()).write.partitionBy("bucket").parquet(f"{tmp_path}/s/data/b=1")
    assert [r.v for r in kept.read().collect()] == ["a"]
    step(rows(spark, (1, 2, "b")), 1)
    assert [r.v for r in kept.read().collect()] == ["b"]
    step(spark.createDataFrame([], SCHEMA), 2)
    assert [r.v for r in kept.read().collect()] == ["b"]


def test_streamed_upserts(spark, tmp_path):
    for values in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 1, "d")]):
        rows(spark, *values).write.mode("append").parquet(f"{tmp_path}/in")
        events.start_upserts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/s", f"{tmp_path}/c", "id", "at").awaitTermination()
    assert sorted((r.id, r.v) for r in store.Store(spark, f"{tmp_path}/s", SCHEMA, "id").read().collect()) == [(1, "c"), (2, "b")]


def test_only_changed_pages_are_extracted(spark, tmp_path):
    kept = store.Store(spark, f"{tmp_path}/s", store.EXTRACTED, "url", 4)
    seen = []

    def extract(df):
        seen.append(sorted(r.url for r in df.select("url").collect()))
        facts = documents.page_facts(F.col("html"))
        return df.select("*", facts[0], facts[1])

    pages = lambda *p: spark.createDataFrame(list(p), "url string, page_id long, depth int, html string")
    one = store.extraction(kept, extract, "v1")
    one(pages(("u1", 1, 0, "<title>a</title>"), ("u1", 2, 0, "<title>b</title>"), ("u2", 3, 1, "x")), 0)
    one(pages(("u1", 2, 0, "<title>b</title>"), ("u2", 3, 1, "y")), 1)
    store.extraction(kept, extract, "v2")(pages(("u1", 2, 0, "<title>b</title>")), 2)
    assert seen == [["u1", "u2"], ["u2"], ["u1"]]
    assert {r.url: (r.title, r.version, r.extractor) for r in kept.read().collect()} == {"u1": ("b", 2, "v2"), "u2": ("", 2, "v1")}


def test_counts_are_observed_by_the_writing_job(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 30, "a").otherwise("b").alias("k"))
    got = runs.written(df, f"{tmp_path}/x", {"few": F.col("k") == "a"})
    assert got["rows"] == 100 and got["few"] == 30
    again = runs.written(spark.read.parquet(f"{tmp_path}/x").orderBy(F.desc("id")), f"{tmp_path}/y")
    assert again["content_hash"] == got["content_hash"]
    empty = runs.written(df.where("false"), f"{tmp_path}/z")
    assert empty["rows"] == 0 and empty["content_hash"] == "0"
    m = runs.manifest(spark, "r", [("x", f"{tmp_path}/x", got), ("z", f"{tmp_path}/z", empty)])
    assert [r.intact for r in runs.verified(m).orderBy("ordinal").collect()] == [True, True]
    df.where("id <> 5").write.mode("overwrite").parquet(f"{tmp_path}/x")
    assert [r.intact for r in runs.verified(m).orderBy("ordinal").collect()] == [False, True]


def test_runs_are_merged_and_the_latest_found(spark):
    schema = "run_id string, status string, finished_at string, summary map<string,string>"
    old = spark.createDataFrame([("a", "ok", "2026-01-01", {"x": "1", "y": "2"}), ("b", "ok", None, None)], schema)
    new = spark.createDataFrame([("a", None, "2026-01-02", {"y": "3", "z": "4"}), ("c", "failed", "2026-01-02", {})], schema)
    got = {r.run_id: r for r in runs.merged(old, new).collect()}
    assert got["a"].summary == {"x": "1", "y": "3", "z": "4"} and got["a"].status == "ok" and got["a"].finished_at == "2026-01-02"
    assert got["b"].summary == {} and got["c"].status == "failed"
    latest = lambda c: [r.run_id for r in runs.latest(runs.merged(old, new), c).collect()]
    assert latest(F.lit(True)) == ["c"] and latest(F.col("status") == "ok") == ["a"] and latest(F.lit(False)) == []
    assert [r.run_id for r in runs.latest(runs.merged(old, new), F.col("run_id") == "b", recent=2).collect()] == []


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    from quillon.sources.tables import numbered_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes("﻿".encode() + b"\r\n".join(b"" if i % 50 == 7 else b"line %d" % i for i in range(1, 4001)))
    (tmp_path / "in" / "b.jsonl").write_text("x\n\n \ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = numbered_lines(spark, f"{tmp_path}/in")
        assert lines.rdd.getNumPartitions() > 1
        rows = [(r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in lines.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r[1:] for r in rows if r[0] == "b.jsonl") == [(1, "x"), (4, "y")]
    assert sorted(r[1:] for r in rows if r[0] == "a.jsonl") == [(i, f"line {i}") for i in range(1, 4001) if i % 50 != 7]
