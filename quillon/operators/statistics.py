"""Exact statistics of a read model, and the distributions that charts draw. Amounts are never added up: bounds and unknown figures have no sum."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised

# Provinces and territories by code.
REGIONS = {
    "BC": "British Columbia",
    "AB": "Alberta",
    "SK": "Saskatchewan",
    "MB": "Manitoba",
    "ON": "Ontario",
    "QC": "Quebec",
    "NB": "New Brunswick",
    "NS": "Nova Scotia",
    "PE": "Prince Edward Island",
    "NL": "Newfoundland and Labrador",
    "YT": "Yukon",
    "NT": "Northwest Territories",
    "NU": "Nunavut",
}


def regions(spark) -> DataFrame:
    return spark.createDataFrame(list(REGIONS.items()), "code string, name string")


def scope(province: Column, nationwide: str = "all") -> Column:
    return F.when(F.coalesce(province, F.lit("")) == "", "unspecified").when(province == nationwide, "national").otherwise("regional")


def overview(records: DataFrame, province: str, amount: str, nationwide: str = "all", limit: int = 5000, verified: str | None = None, levels: str | None = None) -> DataFrame:
    """One row of counts, in one pass: total, by scope, listed and unknown amounts, the largest, and bands."""
    where, x = scope(F.col(province), nationwide), F.col(amount)
    aggs = [
        F.count("*").alias("total"),
        *(F.count_if(where == s).alias(f"{s}_count") for s in ("national", "regional", "unspecified")),
        F.count(x).alias("amount_listed"),
        F.count_if(x.isNull()).alias("amount_unknown"),
        F.max(x).alias("amount_highest"),
        F.count_if(x <= limit).alias("up_to_limit"),
        F.count_if(x > limit).alias("above_limit"),
    ]
    if verified:
        aggs.append(F.count_if(F.coalesce(F.col(verified), F.lit("")) != "").alias("verified_records"))
    if levels:
        aggs.append(F.count_if(F.coalesce(F.size(levels), F.lit(0)) <= 0).alias("unknown_level"))
    return records.agg(*aggs)


def by_region(records: DataFrame, province: str, names: DataFrame, nationwide: str = "all") -> DataFrame:
    """(name, regional_count, national_count, reach_count) of every name, also those without a record. names: a small dimension with a column name."""
    counts = records.groupBy(F.col(province).alias("name")).agg(F.count("*").alias("n"))
    national = counts.agg(F.coalesce(F.sum(F.when(F.col("name") == nationwide, F.col("n"))), F.lit(0)).alias("national_count"))
    regional = F.coalesce("n", F.lit(0))
    return names.select("name").join(counts, "name", "left").crossJoin(F.broadcast(national)).select("name", regional.alias("regional_count"), "national_count", (regional + F.col("national_count")).alias("reach_count"))


def by_value(records: DataFrame, values: Column, wanted: Sequence[str] | None = None) -> DataFrame:
    """(value, n) of an array column: records that have each value, so that counts overlap; wanted values without any have 0."""
    counted = records.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    if wanted is None:
        return counted
    names = records.sparkSession.createDataFrame([(w,) for w in wanted], "value string")
    return names.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def by_kind(records: DataFrame, kind: str, missing: str = "unspecified") -> DataFrame:
    return records.groupBy(F.coalesce(F.col(kind), F.lit(missing)).alias("kind")).agg(F.count("*").alias("n"))


def facet_cube(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by every combination of the columns and of their totals, in one pass; grouped says which are totals."""
    return records.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("grouped"))


def figures(records: DataFrame, amount: Column, kind: Column | None = None, currency: Column | None = None) -> DataFrame:
    """Single amounts that may be compared: not negative, in dollars, not a pooled total."""
    keep = amount.try_cast("double") >= 0
    if kind is not None:
        keep &= F.coalesce(kind, F.lit("")) != "pooled_total"
    if currency is not None:
        keep &= F.coalesce(currency, F.lit("CAD")) == "CAD"
    return records.where(keep).select(amount.try_cast("double").alias("x"))


def running(values: DataFrame, x: str) -> DataFrame:
    """(x, n, upto, total) of each distinct value: how many there are, how many up to it, and how many in all.

    Distinct values are counted first and sorted in ranges of about equal size, whatever their distribution; a range's
    sums begin after those of the ranges before it, so no task sees all of them.
    """
    counts = values.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n"))
    ordered = materialised(counts.orderBy(x).select(x, "n", F.spark_partition_id().alias("_range")))
    sums = ordered.groupBy("_range").agg(F.sum("n").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("total"))  # as many rows as ranges
    within = F.sum("n").over(Window.partitionBy("_range").orderBy(x))
    return ordered.join(F.broadcast(before), "_range").select(x, "n", (F.col("_before") + within).alias("upto"), "total")


def quantiles(values: DataFrame, x: str, shares: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation, one column for each share; null without a value."""
    at = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    value = F.col(x).cast("double")
    ends = [F.min(F.when(F.col("upto") > k, value)).alias(f"{side}{i}") for i, q in enumerate(shares) for side, k in (("a", F.floor(at(q))), ("b", F.ceil(at(q))))]
    found = running(values, x).agg(F.max("total").alias("total"), *ends)
    part = lambda q: at(q) - F.floor(at(q))
    return found.select(*((F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * part(q)).alias(f"q{round(q * 100):02d}") for i, q in enumerate(shares)))


def ecdf(values: DataFrame, x: str) -> DataFrame:
    """(x, share): the share of values up to each distinct one."""
    return running(values, x).select(x, (F.col("upto") / F.col("total")).alias("share"))


def density(values: DataFrame, x: str, points: int = 32) -> DataFrame:
    """(at, density): a Gaussian kernel estimate of log(1 + x) on an even grid; no rows for fewer than two values.

    The bandwidth is 0.9 min(SD, IQR / 1.34) n^(-1/5). Equal values are summed first, and the grid is small.
    """
    logs = values.where(F.col(x).isNotNull()).select(F.log1p(x).alias("v"))
    stats = logs.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 1")
    stats = stats.crossJoin(quantiles(logs, "v", (0.25, 0.75)).select(F.col("q25").alias("a"), F.col("q75").alias("b")))  # one row each
    iqr = (F.col("b") - F.col("a")) / 1.34
    spread = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    stats = stats.select("n", "lo", "hi", F.greatest(F.lit(0.9) * spread * F.pow("n", F.lit(-0.2)), F.lit(0.05)).alias("h"))
    weights = logs.groupBy("v").agg(F.count("*").alias("w")).crossJoin(F.broadcast(stats))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))
    spot = F.posexplode(grid)
    terms = weights.select("v", "w", "n", "h", spot.alias("k", "at"))
    return terms.groupBy("k").agg(F.first("at").alias("at"), (F.sum(F.col("w") * F.exp(-F.pow((F.col("at") - F.col("v")) / F.col("h"), 2) / 2)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))


def coverage(records: DataFrame, province: str, group: Column, names: Sequence[str], groups: Sequence[str], nationwide: str = "all") -> DataFrame:
    """(name, group, n) of every pair: records of the region, and nationwide ones in every region."""
    spark = records.sparkSession
    counts = records.select(F.col(province).alias("name"), F.explode(F.array_distinct(group)).alias("group")).groupBy("name", "group").agg(F.count("*").alias("n"))
    pairs = spark.createDataFrame([(n, g) for n in names for g in groups], "name string, group string")
    everywhere = counts.where(F.col("name") == nationwide).select("group", F.col("n").alias("more"))
    return pairs.join(counts, ["name", "group"], "left").join(everywhere, "group", "left").select("name", "group", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))


def top_and_rest(counts: DataFrame, name: str, n: str, most: int = 11, rest: str = "Other") -> DataFrame:
    """The largest groups (ties by name) and all others as one. Only the top is put in order."""
    top = counts.orderBy(F.desc(n), F.asc(name)).limit(most).select(name, n)
    total = counts.agg(F.sum(n).alias("all")).crossJoin(F.broadcast(top.agg(F.coalesce(F.sum(n), F.lit(0)).alias("some"), F.count("*").alias("k"))))
    others = total.where(F.col("all") > F.col("some")).select(F.lit(rest).alias(name), (F.col("all") - F.col("some")).alias(n))
    return top.union(others)


def waffle(counts: DataFrame, name: str, n: str, tiles: int = 100) -> DataFrame:
    """(name, tiles): counts themselves if they fit, else shares of the tiles by the largest remainder. counts is a small table: a row for each kind."""
    total = counts.agg(F.sum(n).alias("all"))
    exact = F.col(n) * tiles / F.col("all")
    shared = counts.crossJoin(F.broadcast(total)).withColumn("base", F.when(F.col("all") <= tiles, F.col(n)).otherwise(F.floor(exact))).withColumn("over", F.when(F.col("all") <= tiles, 0).otherwise(exact - F.floor(exact)))
    w = Window.orderBy(F.desc("over"), F.asc(name))
    left = F.when(F.col("all") <= tiles, 0).otherwise(tiles - F.sum("base").over(Window.partitionBy()))
    return shared.withColumn("left", left).withColumn("rank", F.row_number().over(w)).select(name, (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long").alias("tiles"))


def classes(counts: DataFrame, n: str, most: int = 5) -> DataFrame:
    """Counts with a colour class: 0 for none, else quantile classes of the distinct counts."""
    distinct = counts.where(F.col(n) > 0).select(n).distinct().withColumn("class", F.ntile(most).over(Window.orderBy(n)))
    return counts.join(distinct, n, "left").withColumn("class", F.coalesce("class", F.lit(0)))


def region_summary(records: DataFrame, province: str, amount: str, provider: str, year: Column, verified: Column, names: Sequence[str]) -> DataFrame:
    """(province, n, verified, lowest, highest, oldest, newest, providers); a province that isn't among the names counts as not stated (null)."""
    known = F.when(F.col(province).isin(*names), F.col(province))
    return records.groupBy(known.alias("province")).agg(F.count("*").alias("n"), F.count_if(verified).alias("verified"), F.min(amount).alias("lowest"), F.max(amount).alias("highest"), F.min(year).alias("oldest"), F.max(year).alias("newest"), F.count_distinct(provider).alias("providers"))


def counts_of(records: DataFrame, conditions: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """One row: how many records meet each condition, and distinct values (nulls left out)."""
    return records.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()), *(F.count_distinct(c).alias(k) for k, c in (distinct or {}).items()))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
