"""Folders of small YAML or JSON files: curated mappings, one source a file, and configurations of sources that include other files.

Spark's binary reader opens the files, so they may lie wherever tables may, and lists of small files share tasks. JSON is
read as VARIANT without Python; YAML goes through a helper in Arrow batches, which gives JSON.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..operators import freshness
from ..operators.validation import found
from .tables import materialised

#: Suffixes of files that are read, keys that a source must have, its states of access, its default language.
SUFFIXES = ("yaml", "yml", "json")
REQUIRED = ("source_id", "name", "url", "provider.id", "provider.name", "role", "parser", "allowed_domains", "allowed_paths")
ACCESS = ("unreviewed", "reviewed_ok", "restricted")
LANGUAGE = "en"


@F.pandas_udf(T.StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    """The JSON of a YAML document; null where it can't be read. What is JSON is read as such. Dates become text. Where no YAML reader is installed, only JSON is read."""
    try:
        import yaml
    except ModuleNotFoundError:
        yaml = None
    failures = (ValueError, TypeError, RecursionError) + ((yaml.YAMLError,) if yaml else ())
    loader = getattr(yaml, "CSafeLoader", None) or getattr(yaml, "SafeLoader", None)

    def one(x):
        try:
            return json.dumps(json.loads(x), ensure_ascii=False)
        except (ValueError, RecursionError):
            pass
        try:
            return json.dumps(yaml.load(x, loader), ensure_ascii=False, default=str) if yaml else None
        except failures:
            return None

    return text.map(one, na_action="ignore").astype("object")


def folder_files(spark: SparkSession, path: str, deep: bool = False, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(path, document, issue) of the files of a folder with the suffixes, of its subfolders too if ``deep``, as ``read_files`` gives them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    return read_files(reader.option("recursiveFileLookup", str(deep).lower()).load(path))


def read_files(files: DataFrame) -> DataFrame:
    """(path, document, issue) of files (path, content): JSON where the path ends in .json, else YAML.

    The files may come from Spark's binary reader or from a table, into which a folder of very many small files is better
    put: such a file alone costs a store more than its content. document is a VARIANT, null with the issue ``file.encoding`` (no UTF-8) or ``file.invalid`` (no document, or a JSON
    object with a key twice). A YAML file without content is an empty object; files of no bytes (which Spark leaves out) and those with other suffixes are not read.
    """
    plain = F.regexp_replace(F.when(F.is_valid_utf8("content"), F.col("content").cast("string")), "^\\x{FEFF}", "")
    texts = files.select("path", plain.alias("text"), F.col("path").endswith(".json").alias("_json"))
    # Declared non-deterministic, as a filter on what it gives would else be pushed below it with a second call for each file.
    read_yaml = yaml_json.asNondeterministic()
    written = F.when(F.col("_json"), F.col("text")).otherwise(read_yaml(F.when(~F.col("_json"), F.col("text"))))
    empty = ~F.col("_json") & (written == "null")
    read = texts.withColumn("document", F.try_parse_json(F.when(empty, "{}").otherwise(written)))
    return read.select("path", "document", F.when(F.col("text").isNull(), "file.encoding").when(F.col("document").isNull(), "file.invalid").alias("issue"))


def _text(node: Column | str, key: str) -> Column:
    return F.try_variant_get(node, F.lit(f"$.{key}"), "string")


def mappings(files: DataFrame, key: str = "source_id") -> DataFrame:
    """(source_id, path, document): of all files that state a source the last by path, whole. Files without a document or source give nothing."""
    stated = files.select(_text("document", key).alias(key), "path", "document").where(F.col(key) != "")
    return stated.groupBy(key).agg(F.max("path").alias("path"), F.max_by("document", "path").alias("document"))


def mapping_findings(files: DataFrame, key: str = "source_id") -> DataFrame:
    """Findings (record_id, path, code, severity) about files, by their paths: not readable, without a source, replaced by a later file of the same source."""
    # Documents are read once; only paths, sources and issues are kept.
    stated = materialised(files.select("path", "issue", F.nullif(_text("document", key), F.lit("")).alias("_source")))
    used = stated.where("_source is not null").groupBy("_source").agg(F.max("path").alias("path")).select("path", F.lit(True).alias("_used"))
    code = F.when(F.col("issue").isNotNull(), F.col("issue")).when(F.col("_source").isNull(), "file.no_source").when(F.col("_used").isNull(), "file.replaced")
    each = stated.join(used, "path", "left").select("path", code.alias("_code")).where("_code is not null")
    severity = F.when(F.col("code").isin("file.encoding", "file.invalid"), "error").otherwise("warning")
    return found(each, F.col("path"), F.lit(""), F.col("_code")).withColumn("severity", severity)


def escapes(path: Column) -> Column:
    """Whether a relative path is empty, absolute or leads out of its folder. A null path escapes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (path == "") | F.contains(path, F.lit("\0")) | path.rlike(r"^([A-Za-z]:|[/\\])") | F.array_contains(F.split(plain, "/"), "..")
    return F.coalesce(bad, F.lit(True))


def configured(files: DataFrame, is_root: Column) -> DataFrame:
    """The sources that configuration files list: a root's own first, then those of the files that it includes, in order (files included by others bring their sources, but not their includes).

    One row for each source with root, file (0 for the root, from 1 for its includes), at (its place in the file), path,
    its fields and ``codes``: ``source.missing:<key>``, ``source.duplicate_id`` (an earlier source of the root has the
    id), ``source.access_status``, ``source.start_url:<reason>`` (outside its own domains and paths, or unsafe). An
    included file that is absent, unreadable or outside the root's folder gives one row without a source:
    ``include.missing``, ``include.unreadable`` or ``include.escapes``. A source is accepted if it has no codes.
    """
    roots = files.where(is_root & F.col("document").isNotNull()).select(F.col("path").alias("root"), "document")
    own = roots.select("root", F.lit(0).alias("file"), F.col("root").alias("path"), "document", F.lit(None).cast("string").alias("code"))
    named = roots.select("root", F.posexplode(F.try_variant_get("document", F.lit("$.include"), "array<string>")).alias("_i", "name"))
    beside = F.concat(F.regexp_replace("root", "[^/]*$", ""), F.replace("name", F.lit("\\"), F.lit("/")))
    wanted = named.select("root", (F.col("_i") + 1).alias("file"), F.when(~escapes(F.col("name")), beside).alias("path"))
    there = files.select("path", "document", F.lit(True).alias("_there"))
    code = F.when(F.col("path").isNull(), "include.escapes").when(F.col("_there").isNull(), "include.missing").when(F.col("document").isNull(), "include.unreadable")
    included = wanted.join(there, "path", "left").select("root", "file", "path", "document", code.alias("code"))
    parts = own.unionByName(included)
    listed = parts.where("code is null").select("root", "file", "path", F.posexplode(F.try_variant_get("document", F.lit("$.sources"), "array<variant>")).alias("at", "s"))
    names = lambda key: F.try_variant_get("s", F.lit(f"$.{key}"), "array<string>")
    fields = {k: _text("s", k) for k in ("source_id", "name", "url", "role", "parser", "terms_url", "notes")}
    fields |= {"provider_id": _text("s", "provider.id"), "provider_name": _text("s", "provider.name"), "language": F.coalesce(_text("s", "language"), F.lit(LANGUAGE)), "access_status": F.coalesce(_text("s", "access_status"), F.lit(ACCESS[0]))}
    fields |= {"allowed_domains": names("allowed_domains"), "allowed_paths": names("allowed_paths"), "max_pages": F.nullif(F.try_variant_get("s", F.lit("$.max_pages"), "int"), F.lit(0))}
    sources = listed.select("root", "file", "at", "path", *(c.alias(k) for k, c in fields.items()))
    # The first of an id is found by a partial aggregate, so an id that many sources share is no window of one task.
    first = sources.where("source_id is not null").groupBy("root", "source_id").agg(F.min(F.struct("file", "at")).alias("_first"))
    seen = sources.join(first, ["root", "source_id"], "left")
    column = {k: k.replace(".", "_") for k in REQUIRED}
    refused = F.coalesce(urls.refusal(F.col("url")), F.when(~urls.within(F.col("url"), F.col("allowed_domains"), F.col("allowed_paths")), "not_allowed"))
    checks = [
        *(F.when(F.col(column[k]).isNull(), f"source.missing:{k}") for k in REQUIRED),
        F.when(F.col("_first") != F.struct("file", "at"), "source.duplicate_id"),
        F.when(~F.col("access_status").isin(*ACCESS), "source.access_status"),
        F.when(F.col("url").isNotNull() & refused.isNotNull(), F.concat(F.lit("source.start_url:"), refused)),
    ]
    judged = seen.select("root", "file", "at", "path", *fields, F.array_compact(F.array(*checks)).alias("codes"))
    failed = parts.where("code is not null").select("root", "file", "path", F.array("code").alias("codes"))
    return judged.unionByName(failed, allowMissingColumns=True)


def write_discovery(entries: DataFrame, path: str, source: str, key: str, declared: DataFrame) -> DataFrame:
    """Writes what was discovered as JSON lines, a folder for each source with its entries in order of the key, and a summary of each source; returns the summaries.

    declared: (source, declared), as the sources state it. A source with entries only has no coverage; one without any
    has 0 observed. Ranges of (source, key) go to the tasks, so that a large source is several files.
    """
    entries.repartitionByRange(source, key).sortWithinPartitions(source, key).write.mode("overwrite").partitionBy(source).json(f"{path}/entries")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    written = entries.sparkSession.read.schema(schema).json(f"{path}/entries")
    counts = written.groupBy(source).agg(F.count("*").alias("observed")).join(declared, source, "full")
    summaries = counts.withColumn("observed", F.coalesce("observed", F.lit(0))).withColumn("coverage", freshness.discovery(F.col("observed"), F.col("declared")))
    summaries.write.mode("overwrite").json(f"{path}/summary")
    return summaries
