"""Written intermediate tables, and joins whose small side is broadcast only after a count."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs that may be broadcast: at most some 32 MB on each executor.
BROADCAST_ROWS = 1_000_000
#: Bytes of a batch of rows that goes to Python: Java, the worker and what either keeps for the next batch hold several times as much. Spark's own limit is 10,000 rows or 64 MB.
BATCH_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A shared folder: the cluster's ``spark.checkpoint.dir``; where none is set, a temporary folder of a local session, else one in the warehouse."""
    sc = spark.sparkContext
    if (base := sc.getCheckpointDir()) is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(configured or (tempfile.mkdtemp(prefix="quillon-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"))
        base = sc.getCheckpointDir()
    return base


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send rows to Python in batches of BATCH_BYTES at most (or the session's own limit, if that is less)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", before.lower()).groups()
    limit = int(number) << 10 * " kmgt".index(unit or " ")
    spark.conf.set(key, str(min(limit, BATCH_BYTES) if limit > 0 else BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read from there: later jobs don't recompute them, and they outlive lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator. ``clear`` deletes them; what is still needed by then has to be stored elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.of = spark, [], {}

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/{uuid.uuid4().hex}"
        self.paths.append(path)
        with small_batches(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.of[id(table)] = table, path  # holds the table, so that its id stays its own
        return table

    def settled(self, df: DataFrame) -> DataFrame:
        """As ``stored``; the shuffle files of the job are deleted when it ends, which the table replaces."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            return self.stored(df)
        finally:
            self.spark.conf.set(key, before)

    def drop(self, table: DataFrame) -> None:
        """Deletes one of the tables, which is no longer needed."""
        path = self.of.pop(id(table))[1]
        self.paths.remove(path)
        self._delete([path])

    def keep(self, table: DataFrame) -> None:
        """Leaves one of the tables to the caller: ``clear`` doesn't delete it."""
        self.paths.remove(self.of.pop(id(table))[1])

    def settle(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished jobs that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, paths: list[str]) -> None:
        sc = self.spark.sparkContext
        for path in paths:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        self._delete(self.paths)
        self.paths, self.of = [], {}


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most so many rows."""
    return df.count() <= rows


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is among the stored ids (left_anti: is not). The ids are broadcast if a count shows that they are few; else both sides are shuffled."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if small(ids) else ids, key, how)


#: Bits for each key of a side that is shuffled; of the other side's rows that don't meet it, one in eight goes along at most (more, where all bits would be over the limit).
BITS = 8


def asked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of df but for those that the bits of a stored table's keys rule out. The bits are broadcast, at most BROADCAST_ROWS longs."""
    bits = min(1 << max(6, (BITS * wanted.count() - 1).bit_length()), 64 * BROADCAST_ROWS)
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = wanted.groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = df.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word")
    return held.where(F.col("_bits").bitwiseAND(bit) != 0).select(df.columns)


def met(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of df joined to those of a stored table by its distinct keys, by a shuffle. What the keys' bits rule out stays where it is."""
    return asked(df, wanted, key).join(wanted, key)
