"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed size. Equal blocks get one integer name: the distinct blocks are
hash-partitioned by content, sorted, and numbered in that order. Adjacent names are then named pairwise, level by level,
until each document has a single name. Two documents get the same (level, name) only if all their blocks are equal, so
the identity has no collisions; hashes only place blocks in partitions.

Copies in one window of input rows are folded before anything is shuffled: a text, block or pair that a third of all
documents share has one row for each window, not one for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import only, stored

#: Bytes of a block.
BLOCK = 4096
#: Text bytes in a window of rows, within which equal blocks are folded by a dictionary.
WINDOW_BYTES = 24 << 20
#: Bytes of blocks, and pairs of names, in a partition where there are more partitions than the session asks for.
PART_BYTES, PART_PAIRS = 128 << 20, 4 << 20

ROWS = pa.schema([("kind", pa.int32()), ("win", pa.int64()), ("code", pa.int32()), ("block", pa.binary()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("n_docs", pa.int64()), ("text_sha256", pa.string())])
ROWS_DDL = "kind int, win long, code int, block binary, doc_id long, codes array<int>, n_docs long, text_sha256 string"
#: Kinds of rows: a distinct block, a distinct text and a document, each of one window.
BLOCKS, TEXTS, DOCS = 0, 1, 2


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ``[\\x20\\x09-\\x0D]`` replaced by one space; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    body = b" ".join(raw.split())
    if not body:
        return b" " if raw else b""
    return b" " * raw[:1].isspace() + body + b" " * raw[-1:].isspace()


class _Window:
    """Blocks and texts seen in a run of rows, each once."""

    def __init__(self, number: int, block: int):
        self.number, self.block, self.bytes = number, block, 0
        self.blocks: dict[bytes, int] = {}
        self.texts: dict[tuple[int, ...], int] = {}
        self.least: list[int | None] = []
        self.counts: list[int] = []
        self.docs: list[tuple[int | None, int, str]] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        raw = normalised(text)
        self.bytes += len(raw) + 64
        codes = tuple(self.blocks.setdefault(raw[i : i + self.block], len(self.blocks)) for i in range(0, max(len(raw), 1), self.block))
        code = self.texts.setdefault(codes, len(self.texts))
        if code == len(self.least):
            self.least.append(doc_id)
            self.counts.append(0)
        elif doc_id is not None and (self.least[code] is None or doc_id < self.least[code]):
            self.least[code] = doc_id
        self.counts[code] += 1
        self.docs.append((doc_id, code, hashlib.sha256(raw).hexdigest()))

    def rows(self):
        yield self._batch(BLOCKS, list(range(len(self.blocks))), block=list(self.blocks))
        yield self._batch(TEXTS, list(range(len(self.texts))), doc_id=self.least, codes=[list(c) for c in self.texts], n_docs=self.counts)
        yield self._batch(DOCS, [c for _, c, _ in self.docs], doc_id=[i for i, _, _ in self.docs], text_sha256=[s for _, _, s in self.docs])

    def _batch(self, kind: int, code: list[int], **columns: list) -> pa.RecordBatch:
        n = len(code)
        columns |= {"kind": [kind] * n, "win": [self.number] * n, "code": code}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in ROWS], schema=ROWS)


def _folded(batches, block: int, window_bytes: int):
    task = TaskContext.get()
    base, n = (task.partitionId() if task else 0) << 32, 0
    window = _Window(base, block)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            window.add(doc_id, text.as_py())
            if window.bytes >= window_bytes:
                yield from window.rows()
                n += 1
                window = _Window(base + n, block)
    if window.docs:
        yield from window.rows()


NAMED = pa.schema([("win", pa.int64()), ("code", pa.int32()), ("name", pa.int64())])


def _name_blocks(batches):
    """Names for blocks that come sorted: the place among the partition's distinct blocks, after the partition's number."""
    task = TaskContext.get()
    name, last = ((task.partitionId() if task else 0) << 40) - 1, None
    for batch in batches:
        names = np.empty(batch.num_rows, np.int64)
        for i, block in enumerate(batch.column("block")):
            block = block.as_py()
            if block != last:
                name, last = name + 1, block
            names[i] = name
        yield pa.RecordBatch.from_arrays([batch.column("win"), batch.column("code"), pa.array(names)], schema=NAMED)


def identities(docs: DataFrame, block: int = BLOCK, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text_sha256, keep_id, group_size, kept.

    Null texts count as empty; rows with a null doc_id are kept as rows, and are the one that stays only where a group
    has no other id; repeated doc_ids are rows of their own, of which each with the group's smallest id is kept. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = stored(docs.select("doc_id", "text").mapInArrow(lambda it: _folded(it, block, window_bytes), ROWS_DDL))
    of = lambda kind: folded.where(F.col("kind") == kind)
    # The number of partitions is given, and the sort makes their order a function of the content alone: a task that runs again gives the same names.
    parts = max(parts, of(BLOCKS).count() * block // PART_BYTES)
    names = of(BLOCKS).select("win", "code", "block").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_name_blocks, "win long, code int, name long")
    texts = of(TEXTS).select("win", F.col("code").alias("text"), "codes", "doc_id", "n_docs")
    at = texts.select("win", "text", F.posexplode("codes").alias("pos", "code"), F.size("codes").alias("left"))
    row = stored(at.join(names, ["win", "code"]).select("win", "text", "pos", "left", "name"))
    levels = row.agg(F.max("left")).first()[0] or 1
    done = [row.where("left = 1").select("win", "text", F.lit(0).alias("level"), "name")]
    level = 0
    while levels > 1:
        level, levels = level + 1, (levels + 1) // 2
        row = _paired(row.where("left > 1"), parts)
        done.append(row.where("left = 1").select("win", "text", F.lit(level).alias("level"), "name"))
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    named = stored(named.join(texts.select("win", "text", "doc_id", "n_docs"), ["win", "text"]))
    groups = named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("n_docs").alias("group_size"))
    settled = named.select("win", "text", "level", "name").join(groups, ["level", "name"]).select("win", F.col("text").alias("code"), "keep_id", "group_size")
    out = of(DOCS).select("win", "code", "doc_id", "text_sha256").join(settled, ["win", "code"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _paired(row: DataFrame, parts: int) -> DataFrame:
    """Names for adjacent pairs; an odd last name is paired with none."""
    pairs = row.groupBy("win", "text", (F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        ((F.max("left") + 1) / 2).cast("int").alias("left"),
    )
    pairs = stored(pairs)
    distinct = pairs.select("a", "b").distinct().repartition(max(parts, pairs.count() // PART_PAIRS), "a", "b").sortWithinPartitions("a", "b")
    names = distinct.withColumn("name", F.monotonically_increasing_id())
    return stored(pairs.join(names, ["a", "b"]).select("win", "text", "pos", "left", "name"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that have an equal text with a smaller doc_id. Rows that share a doc_id go together; rows without one stay."""
    dropped = stored(identities(docs).where("doc_id is not null and not kept").select("doc_id").distinct())
    return only(docs, dropped, "doc_id", "left_anti").select(*docs.columns)
