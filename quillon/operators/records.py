"""Whole records: nested and taken apart, their defaults and public form, listings and details."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from . import availability

#: Fields that only the store needs.
INTERNAL = ("content_fingerprint", "is_demo", "content_changed_at", "version")
STORAGE = ("raw_path", "text_path")


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, position: str = "position", child_key: str | None = None) -> DataFrame:
    """Parents with their children (all columns but the key and the position) as an array of structs in order; an empty array without any. Children of no parent are left out."""
    child_key = child_key or key
    fields = [c for c in children.columns if c not in (child_key, position)]
    lists = children.groupBy(F.col(child_key).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.struct(*fields).alias("x")))).alias("_l"))
    kind = F.array().cast(f"array<{children.select(F.struct(*fields).alias('x')).schema['x'].dataType.simpleString()}>")
    return parents.join(lists, F.col(key) == F.col("_parent"), "left").withColumn(name, F.coalesce(F.transform("_l", lambda e: e.x), kind)).drop("_l", "_parent")


#: Lists of a record that have a table of their own.
LISTS = ("cycles", "evidence", "source_refs")
#: The record's key in these tables, whose rows may have ids of their own.
RECORD = "record_id"


def assembled(tables: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """Records of their tables, the inverse of taken_apart: opportunities with those of cycles, evidence and source_refs that are there. A list that the opportunity notes as absent is null."""
    out = tables["opportunities"]
    for name in LISTS:
        if name in tables:
            out = nested(out, tables[name], key, name, child_key=RECORD if RECORD in tables[name].columns else None)
            if "absent" in out.columns:
                out = out.withColumn(name, F.when(~F.array_contains("absent", name), F.col(name)))
    return out.drop("absent")


def unnested(records: DataFrame, key: str, name: str) -> DataFrame:
    """The children of an array of structs with their record (record_id) and their position, from 0."""
    return records.select(F.col(key).alias(RECORD), F.posexplode(name).alias("position", "_x")).select(RECORD, "position", "_x.*")


def members_of(records: DataFrame, key: str = "id") -> DataFrame:
    """(group_id, cycle_key, key, label, url) of the application group of each cycle that has one."""
    app = records.select(key, F.col("application.group_id").alias("_group"), F.col("application.group_label").alias("label"), F.col("application.url").alias("url"), F.explode("cycles").alias("c"))
    return app.select(effective_group(F.col("c.group_stated"), F.col("c.application_group_id"), F.col("_group")).alias("group_id"), "c.cycle_key", key, "label", "url").where("group_id <> ''")


def taken_apart(records: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Tables of records with arrays cycles, evidence and source_refs, and application (group_id, group_label, url): opportunities (with ``absent``, the lists that are null), cycles, evidence, source references, and members of application groups."""
    absent = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in LISTS)))
    return {"opportunities": records.withColumn("absent", absent).drop(*LISTS), "members": members_of(records, key)} | {c: unnested(records, key, c) for c in LISTS}


def effective_group(stated: Column, own: Column, shared: Column) -> Column:
    """A cycle's application group: what it states, even if that is none, else its record's."""
    return F.when(F.coalesce(stated, F.lit(False)), own).otherwise(shared)


def round_trip_losses(records: DataFrame, key: str = "id", tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Records (key) that differ from what their tables (default: as taken_apart makes them) give again, or whose groups' members do; none, if nothing is lost."""
    parts = tables or taken_apart(records, key)
    again = assembled(parts, key)
    digest = lambda df, name: df.select(key, F.xxhash64(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})).alias(name))
    changed = digest(records, "before").join(digest(again, "after"), key, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(key)
    sides = members_of(records, key).withColumn("n", F.lit(1)).unionByName(parts["members"].withColumn("n", F.lit(-1)))
    uneven = sides.groupBy("group_id", "cycle_key", key, "label", "url").agg(F.sum("n").alias("n")).where("n <> 0").select(key)
    return changed.union(uneven).distinct()


def with_defaults(records: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Records with every field of the defaults; a missing or null one gets its default."""
    return records.withColumns({c: F.coalesce(F.col(c), v) if c in records.columns else v for c, v in defaults.items()})


def public(records: DataFrame, internal: Sequence[str] = INTERNAL, storage: Sequence[str] = STORAGE) -> DataFrame:
    """Records without internal fields, their source references without places in the store."""
    shown = records.drop(*internal)
    if "source_refs" not in shown.columns:
        return shown
    fields = [f.name for f in shown.schema["source_refs"].dataType.elementType.fields if f.name not in storage]
    return shown.withColumn("source_refs", F.transform("source_refs", lambda r: F.struct(*(r[f].alias(f) for f in fields))))


def changed_since_verified(changed_at: Column, verified_at: Column) -> Column:
    """Whether the content changed after it was last verified, or was never verified since it did."""
    return F.coalesce(changed_at.isNotNull() & (verified_at.isNull() | (changed_at > verified_at)), F.lit(False))


def gate(records: DataFrame, opportunity_type: str | None = None, include_closed: bool = False, applicability: Sequence[str] = (), exclude_unknown: bool = False) -> DataFrame:
    """Records that a listing may show: published ones, collections only if asked for, closed ones only if asked for, none that is not applicable.

    records: publication_status, opportunity_type, availability (struct with status) of the cycle to show, and the named
    columns of applicability. A record without a cycle is not shown.
    """
    kind = F.col("opportunity_type") != "award_collection" if opportunity_type is None else F.col("opportunity_type") == opportunity_type
    shown = (F.col("publication_status") == "published") & kind & F.col("availability.status").isNotNull()
    if not include_closed:
        shown &= F.col("availability.status") != "closed"
    refused = ("not_applicable", "unknown") if exclude_unknown else ("not_applicable",)
    for c in applicability:
        shown &= F.col(c).isNull() | ~F.col(c).isin(*refused)
    return records.where(shown)


def listing_order() -> list[Column]:
    return [availability.rank(F.col("availability.status")), F.coalesce(F.col("availability.next_deadline"), F.lit(2**62)), F.lower("title"), F.col("id")]


def page(rows: DataFrame, order: Sequence[Column], limit: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
    """The rows of a page in order, and how many there are in all."""
    if not (1 <= limit <= 100 and offset >= 0):
        raise ValueError("limit is 1 to 100, offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def deadline_views(deadlines: Column, as_of: Column, windows: Column | None = None) -> Column:
    """Each deadline with its window, its state at an instant and, where there is only one, its closing instant. windows: their windows_of, if they are there already."""

    def view(d: Column, w: Column) -> Column:
        return F.struct(d.alias("deadline"), dates.state(w, as_of).alias("state"), dates.exact_close(w).alias("closes_utc"), w.flags.alias("flags"))

    if windows is not None:
        return F.zip_with(deadlines, windows, view)
    return F.transform(deadlines, lambda d: dates.bound(dates.close_window(d.kind, d.date, d.local_time, d.timezone), lambda w: view(d, w)))


def next_steps(official_url: Column, route: Column, url: Column, contact_url: Column, instructions: Column, documents: Column, siblings: Column) -> Column:
    """What to do, in order. documents and siblings: arrays of names."""
    # Sentences of the record contract.
    read, contact, apply, prepare = "Read the official page: ", "Contact the administrator to apply or to learn the local deadline: ", "Apply here: ", "Prepare: "
    shared, rules = "This form is shared with: ", ". Each award has its own eligibility rules."
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    asked = F.when(route == "contact_administrator", F.concat(F.lit(contact), F.when(given(contact_url), contact_url).otherwise(official_url))).when(given(url), F.concat(F.lit(apply), url))
    names = lambda lead, a, tail="": F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.concat(F.lit(lead), F.array_join(a, ", "), F.lit(tail)))
    return F.array_compact(F.array(F.concat(F.lit(read), official_url), asked, F.when(given(instructions), instructions), names(prepare, documents), names(shared, siblings, rules)))


def detail(records: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """One row for each record and cycle: availability, deadlines as seen at the instant, amount with its reading, group, whether it is the current cycle, and the titles of other published records that share the current cycle's application.

    records: key, title, publication_status, application (group_id), cycles (cycle_key, starts_on, ends_on, deadlines, amount, group_stated, application_group_id).
    """
    cycles = records.select(key, "title", "publication_status", F.col("application.group_id").alias("_group"), F.explode("cycles").alias("c")).select(key, "title", "publication_status", "_group", "c.*").withColumn("_windows", availability.windows_of(F.col("deadlines")))
    group = effective_group(F.col("group_stated"), F.col("application_group_id"), F.col("_group"))
    seen = cycles.withColumn("group_id", F.when(group != "", group)).withColumn("availability", availability.availability(F.col("starts_on"), F.col("ends_on"), F.col("deadlines"), as_of, F.col("_windows")))
    place = availability.best_first(key, availability.rank(F.col("availability.status")), availability.latest_date(F.col("starts_on"), F.col("ends_on"), F.col("deadlines")), F.col("cycle_key"))
    seen = seen.withColumn("current", place == 1)
    members = seen.where("group_id is not null and publication_status = 'published'").groupBy("group_id", "cycle_key").agg(F.array_sort(F.collect_set(F.struct(F.col(key).alias("id"), "title"))).alias("_all"))
    joined = seen.join(members, ["group_id", "cycle_key"], "left")
    others = F.transform(F.filter("_all", lambda m: m.id != F.col(key)), lambda m: m.title)
    shared = F.when(F.col("current"), F.coalesce(others, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return joined.select(key, "cycle_key", "current", "availability", deadline_views(F.col("deadlines"), as_of, F.col("_windows")).alias("deadlines"), F.col("amount"), money.reading(F.col("amount.kind")).alias("amount_reading"), "group_id", shared.alias("shared_with"))
