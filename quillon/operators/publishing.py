"""From canonical records to a flat read model. What a source doesn't say stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..sources.tables import materialised
from .statistics import REGIONS

NATIONAL = "all"
# Communities, in their order.
COMMUNITIES = {"first_nations": "First Nations", "inuit": "Inuit", "metis": "Métis"}
SPOKEN = {"first nations": "First Nations", "inuit": "Inuit", "métis": "Métis", "metis": "Métis"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def listed_region(summary: Column) -> Column:
    """The region that a directory's summary states: a known name, nationwide, or unknown."""
    stated = F.trim(F.regexp_extract(summary, r"Province/territory:\s*([^.]+)\.", 1))
    return F.when(F.lower(stated).isin("national", "any location"), NATIONAL).when(stated.isin(*REGIONS.values()), stated)


def listed_communities(summary: Column) -> Column:
    """The communities that a directory's summary states, in their order; unknown if any of them is."""
    parts = F.transform(F.split(F.regexp_extract(summary, r"Indigenous group:\s*([^.]+)\.", 1), ";"), lambda p: F.lower(F.trim(p)))
    everyone = F.array(*(F.lit(c) for c in COMMUNITIES.values()))
    # The parts are taken in turn: an unknown one ends the list, unless all communities were named before it.
    all_at = F.array_position(parts, "all indigenous people")
    bad_at = F.array_position(F.transform(parts, lambda p: ~p.isin(*SPOKEN, "all indigenous people")), True)
    named = F.transform(parts, lambda p: F.try_element_at(_map(SPOKEN), p))
    found = F.filter(everyone, lambda c: F.array_contains(named, c))
    return F.when((all_at > 0) & ((bad_at == 0) | (all_at < bad_at)), everyone).when((bad_at == 0) & (F.size(found) > 0), found)


def region(rule_province: Column, directory: Column) -> Column:
    """province and region_basis: rules first, then the directory, else not stated."""
    name = F.coalesce(F.try_element_at(_map(REGIONS), rule_province), rule_province)
    return F.struct(F.coalesce(name, directory).alias("province"), F.when(name.isNotNull(), "rule").when(directory.isNotNull(), "directory").otherwise("not_stated").alias("region_basis"))


def location(province: Column) -> Column:
    return F.when(province.isNull(), "Region not stated").when(province == NATIONAL, "Across Canada").otherwise(province)


def goals(title: Column) -> Column:
    training = F.coalesce(title.rlike(r"(?i)\b(skills?|training|trades?|apprentice\w*)\b") & ~title.rlike(r"(?i)\bresearch\b"), F.lit(False))
    return F.when(training, F.array(F.lit("postsecondary"), F.lit("training"))).otherwise(F.array(F.lit("postsecondary")))


def short_date(day: Column) -> Column:
    """``Nov 3, 2026``."""
    return F.date_format(day, "MMM d, yyyy")


def timing(deadlines: Column) -> Column:
    """How the deadlines (kind, date, raw_text) are announced: dates first, then yearly rules, rolling, administrator."""
    of = lambda kind: F.filter(deadlines, lambda d: d.kind == kind)
    days = F.transform(F.array_sort(F.filter(F.transform(of("date"), lambda d: d.date), lambda x: x.isNotNull())), lambda x: F.coalesce(short_date(dates.iso_date(x)), x))
    yearly = F.transform(of("annual_rule"), lambda d: _short_months(F.trim(F.coalesce(d.raw_text, F.lit("")))))
    return (
        F.when(F.size(of("date")) > 0, F.concat(F.lit("Apply by "), F.array_join(days, " or ")))
        .when(F.size(yearly) > 0, F.concat(F.lit("Due every year — "), F.array_join(F.array_distinct(yearly), " · ")))
        .when(F.size(of("rolling")) > 0, "Rolling intake")
        .when(F.size(of("local_administrator")) > 0, "Dates set by the administrator")
        .otherwise("Confirm the next deadline")
    )


def _short_months(text: Column) -> Column:
    for m in MONTHS:
        text = F.replace(text, F.lit(m), F.lit(m[:3]))
    return text


def source_kind(roles: Column) -> Column:
    """A directory listing if there are sources and all are indexes."""
    only = (F.size(roles) > 0) & (F.size(F.array_except(roles, F.array(F.lit("discovery_index")))) == 0)
    return F.when(F.coalesce(only, F.lit(False)), "directory_listing").otherwise("official_page")


def newest_source(modified: Column) -> Column:
    return F.substring(F.array_max(F.filter(modified, lambda x: F.coalesce(x, F.lit("")) != "")), 1, 10)


def amount(kind: Column, fixed: Column, minimum: Column, maximum: Column) -> Column:
    """amount (fixed and maximum only) and the bounds, as doubles."""
    number = lambda c: c.try_cast("double")
    return F.struct(money.figure(kind, number(fixed), number(maximum)).alias("amount"), F.when(kind == "range", number(minimum)).alias("minimum"), F.when(kind.isin("range", "maximum"), number(maximum)).alias("maximum"))


def display_order(records: DataFrame, key: str, *order: Column) -> DataFrame:
    """Records with a place in steps of 10 by an order. Keys are sorted in ranges; a range's places begin after those before it."""
    names = [f"_o{i}" for i in range(len(order))]
    ordered = materialised(records.select(key, *(o.alias(n) for n, o in zip(names, order))).orderBy(*names, key).select(key, F.monotonically_increasing_id().alias("_id")))
    range_, inside = F.shiftright("_id", 33), F.col("_id") - F.shiftleft(F.shiftright("_id", 33), 33)
    sizes = ordered.groupBy(range_.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # as many rows as ranges
    places = ordered.withColumn("_range", range_).join(F.broadcast(before), "_range").select(key, ((F.col("_before") + inside) * 10).alias("display_order"))
    return records.join(places, key)


def refreshed(stored: DataFrame, bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(action, n) of an upsert of bodies: created, updated, unchanged."""
    joined = bodies.alias("n").join(stored.alias("o"), key, "left")
    action = F.when(F.col(f"o.{body}").isNull(), "created").when(F.col(f"o.{body}").eqNullSafe(F.col(f"n.{body}")), "unchanged").otherwise("updated")
    return joined.groupBy(action.alias("action")).agg(F.count("*").alias("n"))
