"""Idempotent imports: plan, merge, versions. Older input never overwrites newer, and nothing is deleted."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_RANKS = {"pending": 0, "machine_checked": 1, "human_reviewed": 2}
ACTIONS = ("created", "updated", "unchanged", "rejected", "pending_review")


def first_in_batch(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """The batch with ``duplicate``: whether an earlier row has the key."""
    return batch.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)


def content_hash(columns: Sequence[str]) -> Column:
    """Of the columns' values, nulls apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def plan(incoming: DataFrame, stored: DataFrame, key: str, content: Sequence[str], fetched: str, verified: str | None = None, source_key: str | None = None, demo: str | None = None, mode_is_demo: bool = False) -> DataFrame:
    """(key, action, reason, version) of each incoming row, one for each key. stored has a column version.

    In this order: a row of the other mode is rejected; a new key is created; a changed source key waits for review; a
    stored row of the other mode rejects; changed content that was fetched earlier waits, unless it was verified later;
    else updated or unchanged by the content.
    """
    n, o = incoming.alias("n"), stored.alias("o")
    j = n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    new, old = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    exists = old(key).isNotNull()
    changed = ~F.struct(*map(new, content)).eqNullSafe(F.struct(*map(old, content)))
    later = F.coalesce(new(verified) > old(verified), F.lit(False)) if verified else F.lit(False)
    cases = []
    if demo:
        cases.append((F.coalesce(new(demo), F.lit(False)) != F.lit(mode_is_demo), "rejected", "mode_mismatch"))
    cases.append((~exists, "created", "new"))
    if source_key:
        cases.append((~new(source_key).eqNullSafe(old(source_key)), "pending_review", "source_key_changed"))
    if demo:
        cases.append((~new(demo).eqNullSafe(old(demo)), "rejected", "mode_differs_from_stored"))
    cases += [(changed & F.coalesce(new(fetched) < old(fetched), F.lit(False)) & ~later, "pending_review", "older_than_stored"), (changed, "updated", "content_changed")]
    action, why = F.lit("unchanged"), F.lit("no_change")
    for condition, a, r in reversed(cases):
        action, why = F.when(condition, a).otherwise(action), F.when(condition, r).otherwise(why)
    version = F.coalesce(old("version"), F.lit(0)) + F.when(action.isin("created", "updated"), 1).otherwise(0)
    return j.select(new(key).alias(key), action.alias("action"), why.alias("reason"), version.alias("version"))


def merged(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer merge: keys, values with the incoming row winning as a whole, and an action created, updated, unchanged or retained."""
    o, n = stored.alias("o"), incoming.alias("n")
    j = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    is_new, is_old = F.col(f"n.{keys[0]}").isNotNull(), F.col(f"o.{keys[0]}").isNotNull()
    same = F.struct(*(F.col(f"o.{v}") for v in values)).eqNullSafe(F.struct(*(F.col(f"n.{v}") for v in values)))
    action = F.when(~is_new, "retained").when(~is_old, "created").when(same, "unchanged").otherwise("updated")
    return j.select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys), *(F.when(is_new, F.col(f"n.{v}")).otherwise(F.col(f"o.{v}")).alias(v) for v in values), action.alias("action"))


def settled_review(old: Column, new: Column) -> Column:
    """The higher review of two; a rejection always holds."""
    ranks = F.create_map(*(F.lit(x) for kv in REVIEW_RANKS.items() for x in kv))
    rank = lambda c: F.coalesce(F.try_element_at(ranks, c), F.lit(0))
    return F.when(new == "rejected", new).when(rank(old) >= rank(new), F.coalesce(old, new)).otherwise(new)


def settled_publication(old: Column, new: Column, review: Column) -> Column:
    """Archived before published before the incoming state; only checked records are published."""
    return F.when(review == "rejected", "draft").when((old == "archived") | (new == "archived"), "archived").when(((old == "published") | (new == "published")) & review.isin("machine_checked", "human_reviewed"), "published").otherwise(new)


def union_by_key(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows by key, the incoming one where both have it."""
    return incoming.unionByName(stored.join(incoming.select(key), key, "left_anti"))


def record_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, path, change, old, new) of fields that differ between rows that both tables have, as text."""
    pairs = old.alias("o").join(new.alias("n"), key)
    entries = F.array(*(F.struct(F.lit("/" + f.replace("~", "~0").replace("/", "~1")).alias("path"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields))
    changed = pairs.select(key, F.explode(entries).alias("e")).select(key, "e.*").where(~F.col("old").eqNullSafe(F.col("new")))
    return changed.select(key, "path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified").alias("change"), "old", "new")


def action_counts(planned: DataFrame, actions: Sequence[str] = ACTIONS) -> DataFrame:
    names = planned.sparkSession.createDataFrame([(a,) for a in actions], "action string")
    return names.join(planned.groupBy("action").agg(F.count("*").alias("n")), "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n"))


def applied(stored: DataFrame, incoming: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """The next version of the store: created and updated rows from the input with their version, all others as they are."""
    taken = planned.where(F.col("action").isin("created", "updated")).select(key, F.col("version").alias("_version"))
    fresh = incoming.join(taken, key).withColumn("version", F.col("_version")).drop("_version")
    return fresh.unionByName(stored.join(taken.select(key), key, "left_anti"))


def superseded(listed: DataFrame, preferred: DataFrame, key: str, title: str, provider: str) -> DataFrame:
    """Keys of listed rows that a preferred row replaces: by key, or by an equal title where one provider's name holds the other's. Titles and names come in comparison form."""
    by_key = listed.join(preferred.select(key), key, "left_semi").select(key)
    # A semi join gives a row once, however many preferred rows share its title; repeated ones of these are one.
    p = preferred.select(F.col(title).alias("_title"), F.col(provider).alias("_other")).distinct()
    holds = F.contains(F.col(provider), F.col("_other")) | F.contains(F.col("_other"), F.col(provider))
    by_title = listed.join(p, (F.col(title) == F.col("_title")) & holds, "left_semi").select(key)
    return by_key.union(by_title).distinct()


def versions(changes: DataFrame, key: str, order: Column) -> DataFrame:
    """Changes with the version each makes, from 1."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(order)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def json_leaves(s: pd.Series) -> pd.Series:
    """JSON pointer and JSON text of each scalar and each empty list or object of a document, in order of the pointers; null where it can't be read."""

    def walk(x, path):
        items = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
        if not items or (isinstance(x, (dict, list)) and not x):
            return [(path, json.dumps(x, ensure_ascii=False))]
        return [leaf for k, v in items for leaf in walk(v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")]

    def leaves(text):
        try:
            return [{"path": p, "value": v} for p, v in sorted(walk(json.loads(text), ""))]
        except ValueError:
            return None

    return s.map(leaves, na_action="ignore")


def document_diff(old: DataFrame, new: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, change, old, new) of the leaves that differ between JSON documents of one key; those of a document that only one table has, or that can't be read, are all added or removed."""
    each = lambda df, name: df.select(key, F.explode(json_leaves(document)).alias("e")).select(key, "e.path", F.col("e.value").alias(name))
    both = each(old, "old").join(each(new, "new"), [key, "path"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, "path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified").alias("change"), "old", "new")


def import_gate(planned: DataFrame, issues: DataFrame, key: str, mode: str = "all_or_nothing") -> DataFrame:
    """The plan after findings: rows with an error are rejected; with all_or_nothing, one error rejects every row; dry_run marks what would be done.

    planned: (key, action, ...). Adds a column outcome: applied, rejected, held (not done because of others) or planned.
    """
    if mode not in ("all_or_nothing", "partial", "dry_run"):
        raise ValueError(mode)
    bad = issues.where("severity = 'error'").select(F.col("record_id").alias("_id")).distinct()
    marked = planned.join(bad, planned[key].cast("string") == bad["_id"], "left").withColumn("_bad", F.col("_id").isNotNull() | (F.col("action") == "rejected")).drop("_id")
    if mode == "all_or_nothing":
        any_bad = marked.agg(F.coalesce(F.max("_bad"), F.lit(False)).alias("_any"))
        outcome = F.when(F.col("_bad"), "rejected").when(F.col("_any"), "held").otherwise("applied")
        return marked.crossJoin(F.broadcast(any_bad)).withColumn("outcome", outcome).drop("_bad", "_any")  # one row
    return marked.withColumn("outcome", F.when(F.col("_bad"), "rejected").otherwise("planned" if mode == "dry_run" else "applied")).drop("_bad")


def quarantined(records: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """One row for each error of a rejected record, with the record as canonical text for a later look."""
    errors = issues.where("severity = 'error'").select(F.col("record_id").alias("_id"), "path", "code")
    kept = records.select(F.col(key).cast("string").alias("_id"), F.to_json(F.struct(*sorted(records.columns))).alias("record"))
    return errors.join(kept, "_id").select(F.col("_id").alias("record_id"), "path", "code", "record")
