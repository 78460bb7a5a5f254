"""Readers and writers: numbered JSON lines, canonical JSON, content-addressed appends, safe CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, has_duplicate_keys, sha256
from ..functions.text import formula_safe


def materialised(df: DataFrame) -> DataFrame:
    """The rows, computed once: cut by checkpoint() where the session has a checkpoint folder, else cached."""
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc.getCheckpointDir() else df.cache()


def folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which a cluster's machines share; below the warehouse where none is set."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base}/{uuid.uuid4().hex}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the non-blank lines of text files, from 1, without a byte-order mark (the reader leaves it out).

    Files are split as Spark splits them: lines are numbered within each block of a file, and a block's numbers begin after
    those of the blocks before it, by one sum over as many rows as there are blocks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value"), F.monotonically_increasing_id().alias("_id"))
    blocks = materialised(lines.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = lines.join(before.select("path", "_block", "_first", "_before"), ["path", "_block"]).withColumn("line_no", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int"))
    return numbered.select("path", "line_no", F.regexp_replace("value", "\r$", "").alias("line")).where(F.trim("line") != "")


def parsed_lines(lines: DataFrame, schema) -> DataFrame:
    """Lines with the parsed ``record`` (null where it is no object of the schema) and an issue code: json.invalid, json.duplicate_key or null."""
    record = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    twice = F.coalesce(has_duplicate_keys("line"), F.lit(False))
    readable = F.coalesce(F.try_parse_json("line").isNotNull(), F.lit(False))
    return lines.withColumn("issue", F.when(twice, "json.duplicate_key").when(~readable, "json.invalid")).withColumn("record", F.when(F.col("issue").isNull(), record))


def write_json_lines(df: DataFrame, path: str, partitions: int | None = None, order: str = "id") -> None:
    """One object a line, with sorted keys and its characters as they are, in files that are in order."""
    lines = df.repartitionByRange(*(x for x in (partitions, order) if x is not None)).sortWithinPartitions(order).select(canonical_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Cells that a spreadsheet would take for formulas are quoted."""
    safe = [formula_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").csv(path, header=True)


def absent(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't stored, one for each key: what a content-addressed store appends."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def raw_store(files: DataFrame) -> DataFrame:
    """Binary files (path, content) by their hash, each content once, under its least path."""
    each = files.select(sha256("content").alias("raw_sha256"), "path", "content")
    return each.groupBy("raw_sha256").agg(F.min("path").alias("path"), F.any_value("content").alias("content"))


def replaced(df: DataFrame, path: str) -> DataFrame:
    """Writes to a new folder below path and returns it read again: readers of an older version keep theirs."""
    target = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


def institutions(rows: DataFrame) -> DataFrame:
    """(alias, id) of names that stand for exactly one id, from rows (id, name, aliases): lower case, single spaces."""
    names = rows.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    plain = names.select("id", F.lower(F.trim(F.regexp_replace("alias", r"(?U)\s+", " "))).alias("alias"))
    return plain.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("alias", "id")
