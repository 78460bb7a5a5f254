"""Joins of large tables with the rows that a stored one asks for."""

from pyspark.sql import functions as F

from quillon.llm import scratch


def test_rows_that_nothing_asks_for_are_not_shuffled(spark, monkeypatch):
    docs = spark.range(20_000).select("id", F.concat(F.lit("text "), "id").alias("text")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'none' UNION ALL SELECT -7, 'one' UNION ALL SELECT -7, 'two'"))
    wanted = spark.range(0, 20_000, 40).select("id", F.array("id").alias("wanted")).union(spark.sql("SELECT -7L, array(1L) UNION ALL SELECT -8L, array(2L) UNION ALL SELECT NULL, array(3L)"))
    want = sorted(map(tuple, docs.join(wanted, "id").collect()))
    got = scratch.met(docs, wanted, "id")
    assert got.columns == ["id", "text", "wanted"] and sorted(map(tuple, got.collect())) == want and len(want) == 502
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan and "rightHint=(strategy=broadcast)" in plan
    # Fewer bits than keys: more rows go along, and the same come out.
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, scratch.met(docs, wanted, "id").collect())) == want


def test_few_rows_pass_the_bits(spark):
    docs, wanted = spark.range(20_000), spark.range(0, 20_000, 40)
    ruled = scratch.asked(docs, wanted, "id")
    assert ruled.columns == ["id"] and 500 <= ruled.count() < 20_000 // 6
