"""Profiles matched against records with rules: truth, status, what is missing, groups that share an application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised
from . import rules as R
from .availability import FAR


def leaf_truths(nodes: DataFrame, profiles: DataFrame, key: str, fields: dict[str, str], scale: str | None = None) -> DataFrame:
    """(key, rule_id, node_id, truth, field, reason) of every profile and leaf. Profiles meet rules only through the fields that rules name."""
    long = R.unpivoted(profiles, key, fields)
    if scale is not None:
        long = long.join(profiles.select(key, F.col(scale).cast("decimal(9,3)").alias("have_scale")), key)
    else:
        long = long.withColumn("have_scale", F.lit(None).cast("decimal(9,3)"))
    leaves = nodes.where("kind = 'predicate'").select("rule_id", "node_id", "field", "op", "value_arr", F.col("scale").try_cast("decimal(9,3)").alias("want_scale"))
    joined = long.join(leaves, "field")
    same_scale = F.col("have_scale") == F.col("want_scale")
    truth = R.leaf_truth(F.col("kind"), F.col("op"), F.col("have"), F.col("value_arr"), same_scale)
    reason = F.when(truth == R.UNKNOWN, F.when(F.col("have").isNull() | ((F.col("kind") == "decimal") & F.col("have_scale").isNull()), "profile_missing").when(F.col("kind") == "decimal", "profile_scale_mismatch").otherwise("mapping_ambiguous"))
    known = joined.select(key, "rule_id", "node_id", truth.alias("truth"), "field", reason.alias("reason"))
    # Conditions that nobody structured are unknown for every profile; rules are the small side.
    open_ = nodes.where("kind = 'unknown'").select("rule_id", "node_id")
    everyone = profiles.select(key).crossJoin(open_).select(key, "rule_id", "node_id", F.lit(R.UNKNOWN).alias("truth"), F.lit(None).cast("string").alias("field"), F.lit("source_unknown").alias("reason"))
    return known.unionByName(everyone)


#: What ``explained`` says of a leaf besides its truth.
SAID = ("path", "evidence_ids", "says")
# Phrases of the match contract.
PHRASES = {"eq": "is", "in": "is one of", "overlaps": "includes at least one of", "gte": "is at least", "lte": "is at most"}


def description(field: Column, op: Column, values: Column, scale: Column, labels: dict[str, str], pretty: dict[str, str]) -> Column:
    """A predicate in words: its field's label, the operator's phrase, and its values, by their names where they have one, else with spaces for underscores."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.lit(None).cast("map<string,string>")
    names = table({"true": "yes", "false": "no"} | pretty)
    said = F.array_join(F.transform(values, lambda v: F.coalesce(F.try_element_at(names, v), F.replace(v, F.lit("_"), F.lit(" ")))), ", ")
    on = F.when(F.coalesce(scale, F.lit("")) != "", F.concat(F.lit(" (on a "), scale, F.lit(" scale)"))).otherwise("")
    return F.concat(F.coalesce(F.try_element_at(table(labels), field), field), F.lit(" "), F.try_element_at(table(PHRASES), op), F.lit(" "), said, on)


def compact(nodes: DataFrame, fields: dict[str, str], describe=None) -> DataFrame:
    """One row for each rule: rule_id, leaves (each with the nodes from itself up to its top node, and its values normalised and as numbers), groups from the deepest up, and top nodes. ``describe`` (of a leaf, its words) adds SAID to the leaves.

    One shuffle by rule; a rule's tree is bounded (rules.MAX_DEPTH levels) and is taken apart within its row.
    """
    kind = lambda f: reduce(lambda rest, kv: F.when(f == kv[0], kv[1]).otherwise(rest), fields.items(), F.lit(None).cast("string"))
    held = ("node_id", "parent_id", "depth", "kind", "field", "op", "value_arr", "scale", *(("reason", "path", "evidence_ids") if describe else ()))
    trees = nodes.groupBy("rule_id").agg(F.collect_list(F.struct(*held)).alias("n"))
    trees = trees.withColumn("parents", F.map_from_entries(F.transform("n", lambda x: F.struct(x.node_id, x.parent_id))))
    is_group = lambda x: x["kind"].isin("all", "any")
    above = lambda path: F.try_element_at("parents", F.element_at(path, -1))
    up = lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(R.MAX_DEPTH)), F.array(x.node_id), lambda path, _: F.when(above(path).isNull(), path).otherwise(F.concat(path, F.array(above(path)))))
    leaf = lambda x: F.struct(x.node_id.alias("node_id"), x["kind"].alias("type"), x.field.alias("field"), x.op.alias("op"), F.transform(x.value_arr, lambda v: R.normalised(kind(x.field), v)).alias("theirs"), F.transform(x.value_arr, R.number).alias("numbers"), x.scale.try_cast("decimal(9,3)").alias("want_scale"), up(x).alias("up"), *((x.path.alias("path"), x.evidence_ids.alias("evidence_ids"), describe(x).alias("says")) if describe else ()))
    group = lambda x: F.struct((-x.depth).alias("up"), x.node_id.alias("node_id"), x["kind"].alias("kind"), F.transform(F.filter("n", lambda y: y.parent_id == x.node_id), lambda y: y.node_id).alias("children"))
    tops = F.transform(F.filter("n", lambda x: x.parent_id.isNull()), lambda x: x.node_id)
    return trees.select("rule_id", F.transform(F.filter("n", lambda x: ~is_group(x)), leaf).alias("leaves"), F.array_sort(F.transform(F.filter("n", is_group), group)).alias("groups"), tops.alias("tops"))


#: Rules that every executor may hold; more are joined without a broadcast.
BROADCAST_RULES = 20_000


def _folded(nodes: DataFrame, profiles: DataFrame, key: str, fields: dict[str, str], scale: str | None, describe=None) -> DataFrame:
    """(key, rule_id, tops, l, m) of every profile and rule: its top nodes, its leaves with their truths, and the truths of all nodes as the only element of an array."""
    mandatory = nodes.where("section in ('mandatory', 'unstructured')")
    trees = materialised(compact(mandatory, fields, describe))  # counted, then joined
    kinds = dict(profiles.dtypes)
    as_array = lambda c: F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    said = F.create_map(*(x for f, k in fields.items() for x in (F.lit(f), F.struct(F.lit(k).alias("kind"), as_array(f).isNotNull().alias("said"), F.transform(as_array(f), lambda v: R.normalised(F.lit(k), v)).alias("mine"), R.number(F.get(as_array(f), 0)).alias("number")))))  # noqa: B023
    mine = F.lit(None).cast("decimal(9,3)") if scale is None else F.col(scale).cast("decimal(9,3)")
    who = profiles.select(key, said.alias("said"), mine.alias("have_scale"))
    both = who.crossJoin(F.broadcast(trees) if trees.count() <= BROADCAST_RULES else trees)

    def judged(leaf: Column) -> Column:
        of = F.try_element_at("said", leaf.field)
        known = leaf.type == "predicate"
        truth = F.when(known, R.truth_of(of.kind, leaf.op, F.coalesce(of.said, F.lit(False)), of.mine, of.number, leaf.theirs, leaf.numbers, F.col("have_scale") == leaf.want_scale)).otherwise(R.UNKNOWN)
        mismatch = of.kind == "decimal"
        reason = F.when(~known, "source_unknown").when(~F.coalesce(of.said, F.lit(False)) | (mismatch & F.col("have_scale").isNull()), "profile_missing").when(mismatch, "profile_scale_mismatch").otherwise("mapping_ambiguous")
        return F.struct(leaf.node_id.alias("id"), truth.cast("int").alias("truth"), F.when(known, leaf.field).alias("field"), reason.alias("reason"), leaf.up.alias("up"), *(leaf[x].alias(x) for x in (SAID if describe else ())))

    def add(m: Column, g: Column) -> Column:
        values = F.transform(g.children, lambda c: F.try_element_at(m, c))
        return F.map_concat(m, F.create_map(g.node_id, F.when(g.kind == "all", F.array_min(values)).otherwise(F.array_max(values))))

    leaves = both.select(key, "rule_id", "groups", "tops", F.transform("leaves", judged).alias("l"))
    first = F.map_from_entries(F.transform("l", lambda x: F.struct(x.id, x.truth)))
    # The result of the fold is referred to again and again; as an array's only element it is computed once.
    return leaves.select(key, "rule_id", "tops", "l", F.array(F.aggregate("groups", first, add)).alias("m"))


def matched(nodes: DataFrame, profiles: DataFrame, key: str, fields: dict[str, str], scale: str | None = None) -> DataFrame:
    """(key, rule_id, truth, match_status, missing_fields) of every profile and rule.

    nodes: as rules.flatten makes them, of the mandatory and unstructured sections; a rule without any is not here. Rules
    are the small side: each profile is evaluated where it is, and only rules travel. A field that rules name and
    profiles don't have is missing.
    """
    folded = _folded(nodes, profiles, key, fields, scale)

    def summed(m: Column) -> Column:
        truth = F.array_min(F.transform("tops", lambda t: F.try_element_at(m, t)))
        open_ = F.filter("l", lambda x: F.forall(x.up, lambda n: F.try_element_at(m, n) == R.UNKNOWN))
        return F.struct(truth.alias("truth"), F.exists(open_, lambda x: x.reason.isin(*R.PROVIDER_REASONS)).alias("provider"), F.array_sort(F.array_distinct(F.transform(F.filter(open_, lambda x: x.reason.isin(*R.PROFILE_REASONS)), lambda x: x.field))).alias("missing"))

    out = folded.select(key, "rule_id", F.inline(F.transform("m", summed)))
    unknown = F.col("truth") == R.UNKNOWN
    return out.select(key, "rule_id", "truth", R.status(F.col("truth"), unknown & F.col("provider")).alias("match_status"), F.when(unknown, F.col("missing")).otherwise(F.array().cast("array<string>")).alias("missing_fields"))


def explained(nodes: DataFrame, profiles: DataFrame, key: str, fields: dict[str, str], labels: dict[str, str], questions: dict[str, str], pretty: dict[str, str] | None = None, scale: str | None = None) -> DataFrame:
    """What ``matched`` finds, with its reasons: passed_rules, failed_rules and unknown_rules (path, field, description, reason, evidence_ids; those leaves that account for the outcome, in their order), missing_fields and clarification_questions by first mention, source_uncertainties, and cited ids in order, each once."""
    says = lambda x: F.when(x["kind"] == "predicate", description(x.field, x.op, x.value_arr, x.scale, labels, pretty or {})).otherwise(F.coalesce(x.reason, F.lit("condition")))
    folded = _folded(nodes, profiles, key, fields, scale, says)
    asks = F.create_map(*(F.lit(x) for kv in questions.items() for x in kv)) if questions else F.lit(None).cast("map<string,string>")

    def summed(m: Column) -> Column:
        whole = F.array_min(F.transform("tops", lambda t: F.try_element_at(m, t)))
        same = F.array_sort(F.filter("l", lambda x: F.forall(x.up, lambda n: F.try_element_at(m, n) == x.truth)))
        return F.struct(whole.alias("truth"), F.filter(same, lambda x: F.when(whole == R.UNKNOWN, x.truth > R.FALSE).otherwise(x.truth == whole)).alias("why"))

    seen = folded.select(key, "rule_id", F.inline(F.transform("m", summed)))
    of = lambda t: F.filter("why", lambda x: x.truth == t)
    rule = lambda x: F.struct(x.path.alias("path"), x.field.alias("field"), x.says.alias("description"), F.when(x.truth == R.UNKNOWN, x.reason).alias("reason"), x.evidence_ids.alias("evidence_ids"))
    open_ = F.col("_open")
    # Sentences of the match contract.
    by_name, by_source = (": your answer could not be matched to the rule by name; the provider must confirm (", ")."), "The source leaves this open: "
    sentence = lambda x: F.when(x.reason == "mapping_ambiguous", F.concat(x.field, F.lit(by_name[0]), x.says, F.lit(by_name[1]))).otherwise(F.concat(F.lit(by_source), x.says))
    out = seen.withColumn("_open", of(R.UNKNOWN))
    out = out.withColumn("missing_fields", F.array_distinct(F.transform(F.filter(open_, lambda x: x.reason.isin(*R.PROFILE_REASONS)), lambda x: x.field)))
    provider = F.exists(open_, lambda x: x.reason.isin(*R.PROVIDER_REASONS))
    lists = [F.transform(of(t), rule).alias(n) for t, n in ((R.TRUE, "passed_rules"), (R.FALSE, "failed_rules"))] + [F.transform(open_, rule).alias("unknown_rules")]
    cited_ids = F.array_distinct(F.flatten(F.concat(*(F.transform(of(t), lambda x: x.evidence_ids) for t in (R.TRUE, R.FALSE, R.UNKNOWN)))))
    return out.select(key, "rule_id", "truth", R.status(F.col("truth"), provider).alias("match_status"), *lists, "missing_fields", F.array_distinct(F.array_compact(F.transform("missing_fields", lambda f: F.try_element_at(asks, f)))).alias("clarification_questions"),
                      F.transform(F.filter(open_, lambda x: x.reason.isin(*R.PROVIDER_REASONS)), sentence).alias("source_uncertainties"), cited_ids.alias("cited"))


def next_action(status: Column, availability: Column, official_url: Column, url: Column, contact_url: Column) -> Column:
    """What a person should do after a match, in one sentence."""
    # Sentences of the match contract.
    refused = "You do not appear to meet the recorded conditions. Check the failed rules and the official page in case your situation is an exception: {official}"
    ask = "Answer the clarification questions so the remaining conditions can be checked."
    confirm = "Some conditions can only be confirmed by the provider or administrator. Contact them via {contact}."
    fit = {
        "open": "You appear to meet the recorded conditions and the application window looks open. Review the official page and apply: {where}",
        "upcoming": "You appear to meet the recorded conditions, but applications have not opened yet. Check {official} for the opening date.",
        "closed": "You appear to meet the recorded conditions, but this cycle has closed. Check {official} for the next intake.",
        "contact_administrator": "You appear to meet the recorded conditions. The deadline is set locally; contact the administrator: {where}",
    }
    other = "You appear to meet the recorded conditions. Confirm the current application window on the official page: {official}"
    given = lambda c: F.when(c != "", c)
    places = {"official": official_url, "contact": F.coalesce(given(contact_url), official_url), "where": F.coalesce(given(url), given(contact_url), official_url)}

    def filled(template: str) -> Column:
        out = F.lit(template)
        for name, value in places.items():
            if "{" + name + "}" in template:
                out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    by_window = reduce(lambda rest, kv: F.when(availability == kv[0], filled(kv[1])).otherwise(rest), fit.items(), filled(other))
    return F.when(status == "not_eligible", filled(refused)).when(status == "needs_information", filled(ask)).when(status == "needs_provider_confirmation", filled(confirm)).otherwise(by_window)


def ordering(status: Column, next_deadline: Column, record: Column, cycle: Column) -> list[Column]:
    """By status, then the next deadline (none last), then ids: a total order."""
    return [R.status_rank(status).asc(), F.coalesce(next_deadline, F.lit(FAR)).asc(), record.asc(), cycle.asc()]


def grouped(matches: DataFrame, group: str, cycle: str, record: str, status: str, order: Column) -> DataFrame:
    """(group, cycle, first, members, counts) of records that share an application in a cycle; records without a group stay alone. Members are in order."""
    alone = F.when(F.col(group).isNull(), F.col(record))
    by = matches.groupBy(F.col(group).alias("group_id"), alone.alias("single_id"), F.col(cycle).alias("cycle_key"))
    return by.agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(record).alias("id")))).alias("m"), F.collect_list(status).alias("s")).select(
        "group_id", "cycle_key", "first", F.transform("m", lambda x: x.id).alias("members"), F.map_from_entries(F.transform(F.array_sort(F.array_distinct("s")), lambda v: F.struct(v, F.size(F.filter("s", lambda y: y == v))))).alias("counts")
    )


def cited(records: DataFrame, evidence: DataFrame, key: str, ids: Column) -> DataFrame:
    """(key, refs): the cited pieces of evidence (key, id, quote, ...) in the order they are first cited, without unknown ids."""
    each = records.select(key, F.posexplode(F.array_distinct(ids)).alias("pos", "id"))
    fields = [c for c in evidence.columns if c != key]
    found = each.join(evidence, [key, "id"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("e")))).alias("x"))
    return found.select(key, F.transform("x", lambda x: x.e).alias("refs"))


def siblings(cycles: DataFrame, record: str, group: str, cycle: str) -> DataFrame:
    """(record, siblings): other records with the same group and cycle, in order."""
    a = cycles.where(F.col(group).isNotNull()).select(F.col(record).alias("_r"), group, cycle)
    members = a.groupBy(group, cycle).agg(F.array_sort(F.collect_set("_r")).alias("all"))
    return a.join(members, [group, cycle]).select(F.col("_r").alias(record), F.array_remove("all", F.col("_r")).alias("siblings"))
