"""Records by id, names that stand for an id, stored pages in the order in which they are replayed, and what became of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from .publishing import display_order
from .statistics import REGIONS

#: Ids that every executor may hold.
BROADCAST_IDS = 100_000
#: Fixed value: what is counted of a source's requests.
COUNTS = ("attempted", "succeeded", "failed", "blocked", "skipped", "not_modified")


def scan(records: DataFrame, published_only: bool = True, demo: bool | None = None) -> DataFrame:
    """Records of one mode, published ones only if asked for. Filters that reach the files."""
    if published_only:
        records = records.where("publication_status = 'published'")
    return records if demo is None else records.where(F.col("is_demo") == demo)


def one(records: DataFrame, key: str, value: object, published_only: bool = True) -> DataFrame:
    """The record with an id; no row if there is none to show."""
    return scan(records, published_only).where(F.col(key) == F.lit(value)).limit(1)


def many(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Records whose id is among ids (key); each once, however often it is asked for."""
    few = ids.select(key).limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return records.join(F.broadcast(ids.select(key).distinct()) if few else ids.select(key).distinct(), key, "left_semi")


def with_institution(profiles: DataFrame, aliases: DataFrame, own: str = "institution_id", name: str = "institution_name") -> DataFrame:
    """Profiles whose institution, where only its name is given, is the one that the name stands for alone (aliases: alias, id); an id that was given stays."""
    said = F.lower(collapse(F.col(name)))
    joined = profiles.withColumn("_name", F.when(F.col(own).isNull(), said)).join(aliases.select(F.col("alias").alias("_name"), F.col("id").alias("_id")), "_name", "left")
    return joined.withColumn(own, F.coalesce(F.col(own), F.col("_id").cast(dict(profiles.dtypes)[own]))).drop("_name", "_id")


def institution_region(predicates: DataFrame, institutions: DataFrame) -> DataFrame:
    """(rule_id, region, basis) of the province of the one institution that a rule's first condition on institutions names (op, value_arr); no row where it names several or an unknown one, or one without a province."""
    names = F.create_map(*(F.lit(x) for kv in REGIONS.items() for x in kv))
    single = predicates.where(F.size("value_arr") == 1).select("rule_id", F.get("value_arr", F.lit(0)).alias("_id"))
    found = single.join(institutions.select(F.col("id").cast("string").alias("_id"), "province"), "_id").where("province <> ''")
    return found.select("rule_id", F.coalesce(F.try_element_at(names, F.col("province")), F.col("province")).alias("region"), F.lit("rule").alias("basis"))


def replayed(entries: DataFrame, source: str = "source_id", status: str = "status", depth: str = "depth", url: str = "final_url") -> DataFrame:
    """Entries that were fetched well, with ``ordinal`` (from 0) and ``key`` (source:ordinal) in their source's order: start pages first, then by address.

    The order is made by one sort in ranges over all sources, so a source with most of the pages is no single task. (source, depth, address) has to be unique.
    """
    ok = entries.where(F.col(status) == "ok").withColumn("_k", F.concat_ws("\u001f", F.col(source).cast("string"), F.coalesce(F.col(depth), F.lit(0)).cast("string"), F.col(url)))
    placed = display_order(ok, "_k", F.col(source), F.coalesce(F.col(depth), F.lit(0)), F.col(url)).withColumn("_at", F.floor(F.col("display_order") / 10))
    first = placed.groupBy(F.col(source).alias("_s")).agg(F.min("_at").alias("_first"))
    made = placed.join(F.broadcast(first) if first.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else first, F.col(source).eqNullSafe(F.col("_s")))
    ordinal = (F.col("_at") - F.col("_first")).cast("long")
    return made.withColumn("ordinal", ordinal).withColumn("key", F.concat(F.col(source).cast("string"), F.lit(":"), ordinal.cast("string"))).drop("_k", "_at", "_s", "_first", "display_order")


def source_states(sources: DataFrame, entries: DataFrame, stats: DataFrame, any_failures: Column, key: str = "source_id", access: str = "access_status") -> DataFrame:
    """(source, status, access, counts) of each source: ok with a page that was fetched well, failed where requests failed or were blocked (or, by any_failures, anything did), else no_data. stats: the source and COUNTS of this run; missing ones are 0."""
    good = entries.where("status = 'ok'").groupBy(key).agg(F.lit(True).alias("_ok"))
    counted = stats.groupBy(key).agg(*(F.sum(c).alias(c) for c in COUNTS))
    joined = sources.select(key, access).join(good, key, "left").join(counted, key, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COUNTS}
    state = F.when(F.coalesce("_ok", F.lit(False)), "ok").when((zero["failed"] > 0) | (zero["blocked"] > 0) | any_failures, "failed").otherwise("no_data")
    return joined.select(key, state.alias("status"), access, *(v.alias(c) for c, v in zero.items()))


def run_summary(states: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: attempted, succeeded and failed sources, and skipped ones."""
    return states.agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"), F.lit(skipped).cast("long").alias("skipped"))
