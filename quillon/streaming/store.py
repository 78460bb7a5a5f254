"""A table by key in buckets of files, changed batch by batch: only touched buckets are written, and a commit names the files that count.

Below its path: ``data/b=<batch>/bucket=<n>`` holds the rows of a bucket as a batch left them, ``commits/<batch>`` the batch that
holds each bucket. A commit is one small file that is renamed into place, so a batch that dies leaves what was there, and one
that runs again writes its own files anew. A batch number that was committed is not applied twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import newest

BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def _held(self) -> dict[int, int]:
        """The batch that wrote each bucket; at most as many entries as buckets."""
        done = self.commits()
        if not done:
            return {}
        return {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.path}/commits/{done[-1]}", wholetext=True).first()[0]).items()}

    def _commit(self, number: int, held: dict[int, int]) -> None:
        fs, temporary = self._fs(f"{self.path}/commits/_{number}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if not fs.rename(temporary, self._fs(f"{self.path}/commits/{number}")[1]):
            raise OSError(f"commit {number} could not be renamed into place")

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows as the last commit left them, of some buckets or all."""
        paths = [f"{self.path}/data/b={b}/bucket={k}" for k, b in self._held().items() if buckets is None or k in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int, change: Callable[[DataFrame, DataFrame], DataFrame], key: str | None = None) -> bool:
        """Commits change(old rows, batch) for the buckets that the batch touches, and says whether it did: a batch with a number that was committed changes nothing."""
        done = self.commits()
        if done and number <= done[-1]:
            return False
        held = self._held()
        rows = batch.persist()
        try:
            touched = [r[0] for r in rows.select(self.bucket(key).alias("b")).distinct().collect()]
            if touched:
                fields = [f.split()[0] for f in self.schema.split(", ")]
                new = change(self.read(touched), rows).select(*fields).withColumn("bucket", self.bucket())
                new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/b={number}")
        finally:
            rows.unpersist()
        fs, _ = self._fs(self.path)
        written = {k: number for k in touched if fs.exists(self._fs(f"{self.path}/data/b={number}/bucket={k}")[1])}
        now = {k: b for k, b in held.items() if k not in touched} | written
        self._commit(number, now)
        # What neither this commit nor the one before names is deleted: readers of the one before keep their files.
        for k, b in (self._before(done) or {}).items():
            if now.get(k) != b and held.get(k) != b:
                old = self._fs(f"{self.path}/data/b={b}/bucket={k}")[1]
                fs.delete(old, True)
        return True

    def _before(self, done: list[int]) -> dict[int, int] | None:
        if len(done) < 2:
            return None
        return {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.path}/commits/{done[-2]}", wholetext=True).first()[0]).items()}


def upserts(store: Store, version: str):
    """For foreachBatch: keeps the newest row of each key."""
    return lambda batch, number: store.apply(batch, number, lambda old, rows: newest(old.unionByName(rows.select(old.columns)), store.key, version))


def start(stream: DataFrame, step: Callable[[DataFrame, int], object], checkpoint: str):
    """A query that takes what has come, batch by batch, and ends."""
    return stream.writeStream.foreachBatch(lambda batch, number: step(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EXTRACTED = "url string, page_id long, depth int, raw_sha256 string, extractor string, title string, n_links int, version int"


def extraction(store: Store, extract: Callable[[DataFrame], DataFrame], extractor: str):
    """For foreachBatch over pages (url, page_id, depth, html), url canonical: pages whose bytes and extractor are those of the stored row are left alone, others are extracted and counted up.

    Of a batch's pages of one url the one with the greatest page_id counts. ``extract`` adds title and n_links to rows with html.
    """
    def change(old: DataFrame, rows: DataFrame) -> DataFrame:
        last = rows.groupBy("url").agg(F.max_by(F.struct("page_id", "depth", "html"), "page_id").alias("p")).select("url", "p.*")
        hashed = last.withColumn("raw_sha256", F.sha2(F.col("html").cast("binary"), 256)).withColumn("extractor", F.lit(extractor))
        new = hashed.join(old.select("url", "raw_sha256", "extractor"), ["url", "raw_sha256", "extractor"], "left_anti")
        made = extract(new).drop("html").join(old.select("url", F.col("version").alias("_v")), "url", "left")
        made = made.withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).select(old.columns)
        return old.join(made.select("url"), "url", "left_anti").unionByName(made)

    return lambda batch, number: store.apply(batch, number, change)

