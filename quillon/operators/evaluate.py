"""Listing rules made from a record's conditions, evaluated for profiles, and pages of matches grouped by application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules as R
from .publishing import COMMUNITIES
from .statistics import REGIONS

# Fields that a listing's rule may name, by the condition's field, and what their values become.
LISTED = {
    "indigenous_identity": "communities",
    "residence_province": "residence_province",
    "institution_province": "institution_province",
    "study_status": "study_mode",
    "education_level": "education_level",
    "institution_id": "institution_id",
    "first_nations_registered": "first_nations_registered",
    "metis_citizen": "metis_citizen",
    "inuit_beneficiary": "inuit_beneficiary",
    "goal": "goal",
}
NEXT_ACTIONS = ("Confirm current requirements with the provider", "Review the evidence and application route")
STATUSES = ("potential_fit", "not_eligible", "needs_provider_confirmation", "needs_information")


def _renamed(values: Column, names: dict[str, str]) -> Column:
    if not names:
        return values
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v), v))


def listing_rules(nodes: DataFrame, education: dict[str, str] | None = None, rule_ids: DataFrame | None = None) -> DataFrame:
    """(rule_id, kind, children) of the listing's rules: a tree's top conditions in their order, each a predicate on a listed field or else unknown.

    nodes: as rules.flatten makes them. Only mandatory top predicates survive; groups and other fields become unknown. A rule
    without a known child, or without any, is unknown as a whole (children null). A single province is renamed, a list
    of them stays as written. A tree without any node is in no node table: rule_ids (rule_id) names the rules that there are.
    """
    top = nodes.where("section = 'mandatory' and parent_id is null")
    listed = F.create_map(*(F.lit(x) for kv in LISTED.items() for x in kv))
    field = F.when(F.col("kind") == "predicate", F.try_element_at(listed, F.col("field")))
    values = F.col("value_arr")
    values = (F.when(F.col("field") == "indigenous_identity", _renamed(values, COMMUNITIES)).when(F.col("field").isin("residence_province", "institution_province") & (F.size(values) == 1), _renamed(values, REGIONS))
              .when(F.col("field") == "education_level", _renamed(values, education or {})).otherwise(values))
    op = F.when(F.col("field") == "indigenous_identity", "overlaps").otherwise(F.col("op"))
    child = F.struct("node_id", field.alias("field"), F.when(field.isNotNull(), op).alias("op"), F.when(field.isNotNull(), values).alias("values"))
    made = (nodes if rule_ids is None else rule_ids).select("rule_id").distinct().join(top.groupBy("rule_id").agg(F.array_sort(F.collect_list(child)).alias("c")), "rule_id", "left")
    known = F.coalesce(F.exists("c", lambda x: x.field.isNotNull()), F.lit(False))
    children = F.transform("c", lambda x: F.struct(x.field.alias("field"), x.op.alias("op"), x["values"].alias("values")))
    return made.select("rule_id", F.when(known, "all").otherwise("unknown").alias("kind"), F.when(known, children).alias("children"))


def first_predicate(nodes: DataFrame, field: str, cycle: str = "cycle") -> DataFrame:
    """(rule_id, op, value_arr) of the first top predicate on a field, by cycle and place; nodes with a column for the cycle's place."""
    found = nodes.where((F.col("section") == "mandatory") & F.col("parent_id").isNull() & (F.col("kind") == "predicate") & (F.col("field") == field))
    return found.groupBy("rule_id").agg(F.min_by(F.struct("op", "value_arr"), F.struct(cycle, "node_id")).alias("p")).select("rule_id", "p.*")


def evaluated(rules: DataFrame, profiles: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, rule_id, result, match_status, missing, source_unknown, next_action) of every profile and listing rule.

    profiles: key, and the fields as text or lists of texts. Missing fields are named where the result is unknown, sorted. Each
    profile is evaluated where it is; rules are the small side and travel, broadcast if there are few.
    """
    from ..sources.tables import materialised
    from .matching import BROADCAST_RULES

    kinds = dict(profiles.dtypes)
    as_array = lambda c: F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    said = F.create_map(*(x for f in fields for x in (F.lit(f), as_array(f))))
    small = materialised(rules)
    both = profiles.select(key, said.alias("said")).crossJoin(F.broadcast(small) if small.count() <= BROADCAST_RULES else small)

    def judged(c: Column) -> Column:
        have = F.try_element_at("said", c.field)
        return F.struct(c.field.alias("field"), F.when(c.field.isNull(), R.UNKNOWN).otherwise(R.simple_truth(c.op, have, c["values"])).alias("truth"))

    leaves = both.withColumn("l", F.transform("children", judged))
    truth = F.when(F.col("kind") == "unknown", R.UNKNOWN).otherwise(F.array_min(F.transform("l", lambda x: x.truth)))
    unknown = F.col("truth") == R.UNKNOWN
    open_ = F.filter("l", lambda x: x.truth == R.UNKNOWN)
    missing = F.array_sort(F.array_distinct(F.transform(F.filter(open_, lambda x: x.field.isNotNull()), lambda x: x.field)))
    source = unknown & ((F.col("kind") == "unknown") | F.coalesce(F.exists("l", lambda x: x.field.isNull()), F.lit(False)))
    out = leaves.withColumn("truth", truth).withColumn("source_unknown", source)
    status = F.when(F.col("truth") == R.TRUE, STATUSES[0]).when(F.col("truth") == R.FALSE, STATUSES[1]).when(F.col("source_unknown"), STATUSES[2]).otherwise(STATUSES[3])
    return out.select(key, "rule_id", F.when(F.col("truth") == R.TRUE, "pass").when(F.col("truth") == R.FALSE, "fail").otherwise("unknown").alias("result"), status.alias("match_status"),
                      F.when(unknown, F.coalesce(missing, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("missing"), "source_unknown", F.when(F.col("source_unknown"), NEXT_ACTIONS[0]).otherwise(NEXT_ACTIONS[1]).alias("next_action"))


def first_mentions(leaves: DataFrame, key: str, field: str, order: Column) -> DataFrame:
    """(key, fields): distinct fields in the order in which they are first mentioned."""
    first = leaves.where(F.col(field).isNotNull()).groupBy(key, field).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(field).alias("f")))), lambda x: x.f).alias("fields"))


class Page:
    """A page of matches: rows, and total, total_groups and excluded_closed_count of the whole."""

    def __init__(self, rows: DataFrame, total: int, total_groups: int | None, excluded: int):
        self.rows, self.total, self.total_groups, self.excluded_closed_count = rows, total, total_groups, excluded


def counted(matches: DataFrame, availability: str, include_closed: bool = False) -> tuple[DataFrame, Column, Column]:
    """The matches that count, and the columns (of an aggregate over all) of their number and of the closed ones left out."""
    closed = F.coalesce(F.col(availability) == "closed", F.lit(False)) & F.lit(not include_closed)
    return matches.where(~closed), F.count_if(~closed), F.count_if(closed)


def page(matches: DataFrame, order: list[Column], availability: str, limit: int, offset: int, include_closed: bool = False) -> Page:
    """Matches offset to offset + limit in a total order, numbered in ``place``; closed ones are counted and left out before. Each partition keeps its first offset + limit rows, which are then merged."""
    kept, n, out = counted(matches, availability, include_closed)
    total, excluded = matches.agg(n, out).first()
    top = kept.orderBy(*order).limit(offset + limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # offset + limit rows
    return Page(top.where(F.col("place") > offset), total, None, excluded)


def group_page(matches: DataFrame, key: str, group: str, cycle: str, status: str, order: list[Column], availability: str, limit: int, offset: int, include_closed: bool = False) -> Page:
    """A page of groups that share an application in a cycle (a match without a group is one of its own), in the order of each one's first match, then of their ids.

    Groups are reduced to their least match and to counts by status before they are ordered, and only a page's groups get their
    members (in order), so no more than a page is collected or sorted whole. Rows: place, group_id, cycle_key, first,
    members, member_status_counts.
    """
    kept, _, _ = counted(matches, availability, include_closed)
    names = [f"_o{i}" for i in range(len(order))]
    least = F.struct(*(o.alias(n) for o, n in zip(order, names)), F.col(key).alias("_id"))
    gid = F.when(F.col(group) != "", F.col(group))
    m = kept.select(gid.alias("group_id"), F.when(gid.isNull(), F.col(key).cast("string")).alias("_single"), F.col(cycle).alias("cycle_key"), F.col(status).alias("_status"), least.alias("_at"))
    by = ["group_id", "_single", "cycle_key"]
    groups = m.groupBy(*by).agg(F.min("_at").alias("_at"), *(F.count_if(F.col("_status") == s).alias(s) for s in R.STATUS_RANKS))
    n, out = counted(matches, availability, include_closed)[1:]
    total, excluded = matches.agg(n, out).first()
    total_groups = groups.count()
    ordered = [F.col("_at").asc(), F.coalesce("group_id", F.lit("")).asc()]
    top = groups.orderBy(*ordered).limit(offset + limit).withColumn("place", F.row_number().over(Window.orderBy(*ordered))).where(F.col("place") > offset)  # at most a page
    wanted = F.broadcast(top.select(*(F.col(c).alias(f"_{c}_") for c in by), "place"))
    inside = reduce(lambda a, c: a & m[c].eqNullSafe(F.col(f"_{c}_")), by, F.lit(True))
    members = m.join(wanted, inside).groupBy("place").agg(F.transform(F.array_sort(F.collect_list("_at")), lambda x: x["_id"]).alias("members"))
    counts = F.map_filter(F.create_map(*(x for s in R.STATUS_RANKS for x in (F.lit(s), F.col(s)))), lambda _, v: v > 0)
    rows = top.join(members, "place").select("place", "group_id", "cycle_key", F.col("_at._id").alias("first"), "members", counts.alias("member_status_counts"))
    return Page(rows, total, total_groups, excluded)
