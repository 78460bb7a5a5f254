"""Streams: windowed counts with late data, and idempotent upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n, total) by tumbling windows; on a stream, rows later than the watermark are left out."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    counted = events.groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return counted.select(F.col("w.start").alias("start"), kind, "n", "total")


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key; of equal versions the greatest by all columns."""
    others = [c for c in rows.columns if c not in (key, version)]
    w = Window.partitionBy(key).orderBy(F.desc(version), *(F.desc(c) for c in others))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(stored: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """The store after a batch: older rows never replace newer ones, and a batch that comes twice changes nothing."""
    return newest(stored.unionByName(batch), key, version)


def start_upserts(stream: DataFrame, path: str, checkpoint: str, key: str, version: str):
    """A query that keeps the newest row of each key in a ``store.Store`` below path: a micro-batch rewrites the buckets that it touches."""
    from .store import Store, start, upserts

    schema = ", ".join(f"{name} {kind}" for name, kind in stream.dtypes)
    return start(stream, upserts(Store(stream.sparkSession, path, schema, key), version), checkpoint)
