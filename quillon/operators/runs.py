"""Runs: what was written is counted and hashed while it is written; summaries are merged, the latest run is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Fixed value: how many runs are looked through for the latest.
RECENT = 25


def content_hash(columns: list[str]) -> Column:
    """Of all rows in any order: the sum of their 64-bit hashes, equal rows counting each time."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def written(df: DataFrame, path: str, counts: dict[str, Column] | None = None) -> dict[str, object]:
    """Writes df as Parquet, and gives rows, content_hash and each of counts (conditions), all observed by the job that writes: one scan, no second job."""
    seen = Observation()
    conditions = [F.count_if(c).alias(name) for name, c in (counts or {}).items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), content_hash(df.columns).alias("content_hash"), *conditions).write.mode("overwrite").parquet(path)
    return seen.get


def manifest(spark, run_id: str, steps: list[tuple[str, str, dict[str, object]]]) -> DataFrame:
    """(run_id, ordinal, step, path, content_hash, counts) of the steps (name, path, what ``written`` gave) of a run, in order."""
    rows = [(run_id, i, name, path, got["content_hash"], {k: int(v) for k, v in got.items() if k != "content_hash"}) for i, (name, path, got) in enumerate(steps)]
    return spark.createDataFrame(rows, "run_id string, ordinal int, step string, path string, content_hash string, counts map<string,bigint>")


def verified(manifest_: DataFrame) -> DataFrame:
    """The manifest with ``intact``: whether each artifact still has the rows and the hash that it was written with. One job for each step."""
    spark, found = manifest_.sparkSession, []
    for r in manifest_.collect():  # one row for each step of a run
        df = spark.read.parquet(r["path"])
        now = df.agg(F.count(F.lit(1)).alias("n"), content_hash(df.columns).alias("h")).first()
        found.append((r["run_id"], r["ordinal"], now["n"] == r["counts"]["rows"] and now["h"] == r["content_hash"]))
    return manifest_.join(spark.createDataFrame(found, "run_id string, ordinal int, intact boolean"), ["run_id", "ordinal"])


def merged(stored: DataFrame, coming: DataFrame, key: str = "run_id", summary: str = "summary") -> DataFrame:
    """Runs by key: values that come win where they aren't null, and a summary (a map) is merged entry by entry, those that come winning."""
    columns = [c for c in stored.columns if c not in (key, summary)]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    o, n = F.coalesce(F.col(f"o.{summary}"), empty), F.coalesce(F.col(f"n.{summary}"), empty)
    kept = F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k))
    joined = stored.alias("o").join(coming.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns), F.map_concat(kept, n).alias(summary))


def latest(runs: DataFrame, wanted: Column, finished: str = "finished_at", key: str = "run_id", recent: int = RECENT) -> DataFrame:
    """Of the most recently finished runs the first that is wanted: the newest, of equals the greatest key; no row if none is."""
    last = runs.orderBy(F.desc_nulls_last(finished), F.desc(key)).limit(recent)
    return last.where(wanted).orderBy(F.desc_nulls_last(finished), F.desc(key)).limit(1)
