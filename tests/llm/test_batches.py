"""Batches that go to Python are bounded in bytes, so that long documents don't fill an executor's memory."""

import pyarrow as pa

from quillon.llm import scratch

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def batches_of(spark, n):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "bytes": pa.array([batch.nbytes], pa.int64())})

    return spark.range(n, numPartitions=1).selectExpr("id", "repeat('x', 3000) AS text").mapInArrow(sizes, "n long, bytes long")


def test_stored_tables_send_small_batches(spark):
    before = spark.conf.get(KEY)
    rows = batches_of(spark, 6000)
    for made in (scratch.stored(rows), scratch.Scratch(spark).stored(rows)):
        got = made.collect()
        assert sum(r["n"] for r in got) == 6000
        assert max(r["bytes"] for r in got) < scratch.BATCH_BYTES + 10_000
    assert spark.conf.get(KEY) == before


def test_a_smaller_limit_of_the_session_holds(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "1m")
    try:
        rows = batches_of(spark, 3000)
        assert max(r["bytes"] for r in scratch.stored(rows).collect()) < (1 << 20) + 10_000
    finally:
        spark.conf.set(KEY, before)
