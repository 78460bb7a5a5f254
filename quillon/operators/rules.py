"""Eligibility rules in three-valued logic, as joins and grouped minima and maxima over a table of nodes.

Truth is 0 (false), 1 (unknown) or 2 (true), so that "all" is a minimum and "any" a maximum. Rules are trees of bounded
depth; they are folded from the deepest level up, one aggregation a level.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

FALSE, UNKNOWN, TRUE = 0, 1, 2
MAX_DEPTH = 6
NODES = "rule_id string, section string, node_id int, parent_id int, depth int, kind string, field string, op string, value_arr array<string>, scale string, reason string, path string, evidence_ids array<string>, error string"

# Profile fields with their kind and the operators each may have.
FIELDS = {
    "indigenous_identity": ("set", ("overlaps",)),
    "first_nations_registered": ("bool", ("eq",)),
    "metis_citizen": ("bool", ("eq",)),
    "metis_org": ("soft", ("eq", "in")),
    "inuit_beneficiary": ("bool", ("eq",)),
    "inuit_org": ("soft", ("eq", "in")),
    "residence_province": ("code", ("eq", "in")),
    "home_community": ("soft", ("eq", "in")),
    "home_region": ("soft", ("eq", "in")),
    "institution_id": ("id", ("eq", "in")),
    "institution_province": ("code", ("eq", "in")),
    "campus": ("soft", ("eq", "in")),
    "education_level": ("enum", ("eq", "in")),
    "program_field": ("soft", ("eq", "in")),
    "study_status": ("enum", ("eq", "in")),
    "year_of_study": ("int", ("eq", "in", "gte", "lte")),
    "gpa": ("decimal", ("gte", "lte")),
}
STATUS_RANKS = {"potential_fit": 0, "needs_information": 1, "needs_provider_confirmation": 2, "not_eligible": 3}
PROFILE_REASONS, PROVIDER_REASONS = ("profile_missing", "profile_scale_mismatch"), ("mapping_ambiguous", "source_unknown")


def flatten(rules: DataFrame, rule_id: str, tree: str) -> DataFrame:
    """Node rows of rule trees in JSON: an object with lists mandatory, preferences and unstructured. Top nodes have no parent.

    A node that breaks the rules (its type, field, operator, value or depth, or an empty group) is unknown and has an error.
    """

    def nodes_of(section: str, top: list, before: int):
        out, stack = [], [(n, None, 0, f"/{section}/{i}") for i, n in enumerate(top)][::-1]
        while stack:
            node, parent, depth, path = stack.pop()
            kind = node.get("type") if isinstance(node, dict) else None
            error = None
            if depth > MAX_DEPTH:
                error = "rule.too_deep"
            elif kind in ("all", "any"):
                error = None if node.get("children") else "rule.empty_group"
            elif kind == "predicate":
                spec = FIELDS.get(node.get("field"))
                error = "rule.unknown_field" if spec is None else "rule.bad_op" if node.get("op") not in spec[1] else "rule.bad_value" if node.get("value") in (None, "", []) else None
            elif kind != "unknown":
                error = "rule.bad_type"
            value = node.get("value") if isinstance(node, dict) else None
            values = None if value is None else [json.dumps(v) if isinstance(v, bool) else str(v) for v in (value if isinstance(value, list) else [value])]
            own = node if isinstance(node, dict) else {}
            number = before + len(out)
            out.append((section, number, parent, depth, "unknown" if error else kind, own.get("field"), own.get("op"), values, None if own.get("scale") is None else str(own["scale"]), own.get("reason"), path, own.get("evidence_ids") or [], error))
            if not error and kind in ("all", "any"):
                stack += [(c, number, depth + 1, f"{path}/children/{i}") for i, c in enumerate(node["children"])][::-1]
        return out

    def run(frames):
        for frame in frames:
            rows = []
            for key, text in zip(frame["rule_id"], frame["tree"]):
                try:
                    whole = json.loads(text)
                except (TypeError, ValueError):
                    whole = {"unstructured": [{"text": "rules could not be read"}]}
                base, n = len(rows), 0
                for section, items in (("mandatory", whole.get("mandatory")), ("preference", whole.get("preferences")), ("unstructured", [{"type": "unknown", "reason": u.get("text"), "evidence_ids": u.get("evidence_ids")} for u in whole.get("unstructured") or []])):
                    rows += [(key, *r) for r in nodes_of(section, items or [], n)]
                    n = len(rows) - base
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")]) if rows else pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in NODES.split(", ")})

    return rules.select(F.col(rule_id).cast("string").alias("rule_id"), F.col(tree).alias("tree")).mapInPandas(run, NODES)


def normalised(kind: Column, value: Column) -> Column:
    plain = F.trim(value)
    return F.when(kind == "code", F.upper(plain)).when(kind.isin("enum", "set", "id"), F.lower(plain)).when(kind == "soft", F.lower(collapse(value))).otherwise(plain)


def unpivoted(profiles: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row (key, field, kind, have) for each profile and field: have is an array of strings, null if nothing was said. An empty list has been said."""
    kinds = dict(profiles.dtypes)
    as_array = lambda c: F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), as_array(f).alias("have")) for f, k in fields.items()))
    return profiles.select(key, F.explode(entries).alias("e")).select(key, "e.field", "e.kind", "e.have")


def leaf_truth(kind: Column, op: Column, have: Column, want: Column, scale_matches: Column | None = None) -> Column:
    """Truth of a predicate: unknown if nothing was said; a free-text name that doesn't match is unknown too, and so is a figure on another scale."""
    mine = F.transform(have, lambda v: normalised(kind, v))
    theirs = F.transform(want, lambda v: normalised(kind, v))
    return truth_of(kind, op, have.isNotNull(), mine, number(F.get(have, 0)), theirs, F.transform(want, number), scale_matches)


def number(value: Column) -> Column:
    return value.try_cast("decimal(18,6)")


def truth_of(kind: Column, op: Column, said: Column, mine: Column, a: Column, theirs: Column, numbers: Column, scale_matches: Column | None = None) -> Column:
    """leaf_truth, of values that are normalised and read as numbers already."""
    b = F.get(numbers, 0)
    numeric = F.when(op == "gte", a >= b).when(op == "lte", a <= b).when(op == "eq", a == b).otherwise(F.exists(numbers, lambda v: v == a))
    passed = F.when(kind.isin("int", "decimal"), numeric).otherwise((F.size(F.array_intersect(mine, theirs)) > 0))
    scale = F.lit(True) if scale_matches is None else F.coalesce(scale_matches, F.lit(False))
    return F.when(~said | ((kind == "decimal") & ~scale), UNKNOWN).when(passed, TRUE).when(passed.isNull() | (kind == "soft"), UNKNOWN).otherwise(FALSE)


def fold(nodes: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, node_id, parent_id, truth) of all nodes. leaves: (key, rule_id, node_id, truth) of all that are not groups.

    One shuffle: the truths of a rule's leaves become a map, and its groups are added to it from the deepest up.
    """
    children = nodes.where("parent_id is not null").groupBy("rule_id", F.col("parent_id").alias("node_id")).agg(F.collect_list(F.col("node_id").alias("c")).alias("children"))
    groups = nodes.where(F.col("kind").isin("all", "any")).select("rule_id", "node_id", "depth", "kind").join(children, ["rule_id", "node_id"])
    ordered = groups.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), "node_id", "kind", "children"))).alias("groups"))
    parents = nodes.groupBy("rule_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "parent_id"))).alias("parents"))
    trees = parents.join(ordered, "rule_id", "left")
    truths = leaves.groupBy(key, "rule_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.col("truth").cast("int").alias("truth")))).alias("m")).join(trees, "rule_id")

    def add(m, g):
        values = F.transform(g.children, lambda c: F.try_element_at(m, c))
        return F.map_concat(m, F.create_map(g.node_id, F.when(g.kind == "all", F.array_min(values)).otherwise(F.array_max(values))))

    whole = truths.select(key, "rule_id", "parents", F.when(F.col("groups").isNull(), F.col("m")).otherwise(F.aggregate("groups", F.col("m"), add)).alias("m"))
    return whole.select(key, "rule_id", "parents", F.explode("m").alias("node_id", "truth")).select(key, "rule_id", "node_id", F.try_element_at("parents", F.col("node_id")).alias("parent_id"), "truth")


def outcome(folded: DataFrame, key: str, rule_ids: DataFrame, extra_unknown: DataFrame | None = None) -> DataFrame:
    """(key, rule_id, truth) of whole rules: all top nodes together; rules in extra_unknown (rule_id) can't be true. Pairs without a node are not in folded and not here: see default_unknown."""
    top = folded.where("parent_id is null").groupBy(key, "rule_id").agg(F.min("truth").alias("truth"))
    if extra_unknown is None:
        return top
    marked = top.join(extra_unknown.select("rule_id").distinct().withColumn("open", F.lit(True)), "rule_id", "left")
    return marked.select(key, "rule_id", F.when(F.col("open") & (F.col("truth") == TRUE), UNKNOWN).otherwise(F.col("truth")).alias("truth"))


def status(truth: Column, provider_reason: Column) -> Column:
    """Match status: an unknown that only the provider can settle asks for confirmation, any other for information."""
    return F.when(truth == FALSE, "not_eligible").when(truth == TRUE, "potential_fit").when(provider_reason, "needs_provider_confirmation").otherwise("needs_information")


def status_rank(status_: Column) -> Column:
    return reduce(lambda rest, kv: F.when(status_ == kv[0], kv[1]).otherwise(rest), STATUS_RANKS.items(), F.lit(None).cast("int"))


def ancestors(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(rule_id, leaf, node_id) of every leaf and each node from itself up to its top node."""
    shape = nodes.select("rule_id", "node_id", "parent_id")
    now = nodes.where(~F.col("kind").isin("all", "any")).select("rule_id", F.col("node_id").alias("leaf"), "node_id", "parent_id")
    out = now
    for _ in range(depth):
        now = now.where("parent_id is not null").select("rule_id", "leaf", F.col("parent_id").alias("node_id")).join(shape, ["rule_id", "node_id"]).select("rule_id", "leaf", "node_id", "parent_id")
        out = out.union(now)
    return out.select("rule_id", "leaf", "node_id")


def blamed(folded: DataFrame, closure: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, leaf, truth) of the leaves that account for an outcome: those with the truth of all nodes above them, failed ones of a false rule, passed ones of a true one, passed and unknown ones of an unknown one."""
    along = closure.join(folded.select(key, "rule_id", "node_id", "truth"), ["rule_id", "node_id"]).groupBy(key, "rule_id", "leaf").agg(F.min("truth").alias("lo"), F.max("truth").alias("hi"))
    same = along.where("lo = hi").select(key, "rule_id", "leaf", F.col("lo").alias("truth"))
    joined = same.join(outcomes.select(key, "rule_id", F.col("truth").alias("whole")), [key, "rule_id"])
    return joined.where(((F.col("whole") == FALSE) & (F.col("truth") == FALSE)) | ((F.col("whole") == TRUE) & (F.col("truth") == TRUE)) | ((F.col("whole") == UNKNOWN) & (F.col("truth") > FALSE))).drop("whole")


def applicability(predicates: DataFrame, record: str) -> DataFrame:
    """(record, applicability) of predicate truths: any true one applies, all false ones don't, else unknown."""
    folded = predicates.groupBy(record).agg(F.max("truth").alias("hi"), F.count("*").alias("n"))
    return folded.select(record, F.when(F.col("hi") == TRUE, "applies").when(F.col("hi") == FALSE, "not_applicable").otherwise("unknown").alias("applicability"))


def simple_truth(op: Column, have: Column, want: Column) -> Column:
    """The listing's own evaluator: equality as written, and an empty list says nothing."""
    meets = F.when(op == "overlaps", F.size(F.array_intersect(have, want)) > 0).otherwise(F.array_contains(want, F.get(have, 0)))
    return F.when(have.isNull() | (F.size(have) == 0), UNKNOWN).when(meets, TRUE).otherwise(FALSE)
