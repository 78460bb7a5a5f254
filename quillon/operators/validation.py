"""Findings about records as rows (record_id, path, code, severity), made by joins and predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

COLUMNS = ("record_id", "path", "code", "severity")


def found(rows: DataFrame, record: Column, path: Column, code: Column, severity: str = "error") -> DataFrame:
    """An issue for each row whose code is not null."""
    return rows.select(record.cast("string").alias("record_id"), path.alias("path"), code.alias("code"), F.lit(severity).alias("severity")).where("code is not null")


def missing_references(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, record: Column, path: Column, code: str) -> DataFrame:
    """Children whose key no parent has; a null key refers to nothing."""
    orphans = children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return found(orphans, record, path, F.lit(code))


def unreferenced(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, record: Column, path: Column, code: str) -> DataFrame:
    """Parents that no child names: a warning."""
    unused = parents.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_anti")
    return found(unused, record, path, F.lit(code), "warning")


def duplicates(rows: DataFrame, key: str, order: Column, record: Column, code: str) -> DataFrame:
    """Rows after the first of a key."""
    later = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n > 1")
    return found(later, record, F.lit("/" + key), F.lit(code))


def conflicts(rows: DataFrame, key: str, value: Column, order: Column, record: Column, code: str) -> DataFrame:
    """Rows whose value differs from that of the key's first row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = rows.withColumn("_first", F.first(value).over(w)).where(~value.eqNullSafe(F.col("_first")))
    return found(other, record, F.lit("/" + key), F.lit(code))


def exploded(rows: DataFrame, record: Column, codes: Column, path: Column, severity: str = "error") -> DataFrame:
    """Issues of an array of codes; what follows a colon in a code ends the path."""
    each = rows.select(record.cast("string").alias("record_id"), path.alias("path"), F.explode(codes).alias("c"))
    tail = F.substring_index("c", ":", -1)
    return each.select("record_id", F.when(F.contains(F.col("c"), F.lit(":")), F.concat("path", F.lit("/"), tail)).otherwise(F.col("path")).alias("path"), F.substring_index("c", ":", 1).alias("code"), F.when(F.substring_index("c", ":", 1).isin(*WARNINGS), "warning").otherwise(severity).alias("severity"))


#: Precisions that a kind of deadline may have.
PRECISIONS = {"date": ("day",), "datetime": ("minute", "second"), "annual_rule": ("month_day",)}
#: Two clocks differ by so many seconds at most when the rules of daylight saving change.
DRIFT = 2 * 3600
WARNINGS = ("deadline.timezone_unrecognised", "deadline.utc_tz_rules_changed", "deadline.precision_mismatch", "amount.value_not_in_quote", "eligibility.no_rules")


def deadline_codes(d: Column, quotes: Column, cycle_key: Column, label: Column) -> Column:
    """What a deadline violates, as ``code`` or ``code:field``; those of WARNINGS are warnings.

    d: a struct with kind, date, local_time, annual_month, annual_day, deadline_at_utc, timezone, precision and
    derived_from. quotes: texts of the evidence that it cites.
    """
    dated, annual = d.kind.isin("date", "datetime"), d.kind == "annual_rule"
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    concrete = [d.date, d.local_time, d.deadline_at_utc]
    yearly = {"annual_month": d.annual_month, "annual_day": d.annual_day}
    window = dates.close_window(d.kind, d.date, d.local_time, d.timezone)

    def by_clock(w: Column) -> Column:
        exact = F.when(w.earliest == w.latest, w.latest)
        stated = F.unix_seconds(d.deadline_at_utc.try_cast("timestamp"))
        there = dated & dates.iso_date(d.date).isNotNull() & d.deadline_at_utc.isNotNull()
        off = F.abs(stated - exact)
        return F.when(there, F.when(exact.isNull(), "deadline.utc_not_exact:deadline_at_utc").when((off > 0) & (off <= DRIFT), "deadline.utc_tz_rules_changed:deadline_at_utc").when(F.coalesce(off > DRIFT, F.lit(True)), "deadline.utc_mismatch:deadline_at_utc"))

    year = F.substring(d.date, 1, 4)
    supported = F.exists(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: F.contains(q, year)) | (d.derived_from.isNotNull() & (F.contains(cycle_key, year) | F.contains(label, year)))
    precise = reduce(lambda rest, kv: F.when(d.kind == kv[0], d.precision.isin(*kv[1])).otherwise(rest), PRECISIONS.items(), d.precision == "none")
    checks = [
        F.when(dated & d.date.isNull(), "deadline.date_required:date"),
        F.when((d.kind == "datetime") & ~given(d.local_time), "deadline.time_required:local_time"),
        F.when((d.kind == "date") & given(d.local_time), "deadline.kind_time_mismatch:local_time"),
        *(F.when(dated & c.isNotNull(), f"deadline.unexpected_field:{f}") for f, c in yearly.items()),
        F.when(annual & F.greatest(*(c.isNull() for c in yearly.values())), "deadline.annual_fields"),
        F.when(annual & ~dates.valid_annual_day(d.annual_month, d.annual_day) & d.annual_month.isNotNull() & d.annual_day.isNotNull(), "deadline.annual_invalid"),
        *(F.when(annual & c.isNotNull(), f"deadline.annual_no_concrete_date:{f}") for f, c in zip(("date", "local_time", "deadline_at_utc"), concrete)),
        F.when(~dated & ~annual & F.coalesce(*(c.cast("string") for c in (*concrete, *yearly.values()))).isNotNull(), "deadline.unexpected_fields"),
        F.when(dated & given(d.timezone) & (dates.zone_of(d.timezone, dates.iso_date(d.date)).status == "unknown"), "deadline.timezone_unrecognised:timezone"),
        dates.bound(window, by_clock),
        F.when(dated & d.date.isNotNull() & ~F.coalesce(supported, F.lit(False)), "deadline.year_not_supported"),
        F.when(~F.coalesce(precise, F.lit(False)), "deadline.precision_mismatch:precision"),
    ]
    return F.array_compact(F.array(*checks))


def amount_in_quotes(values: dict[str, Column], quotes: Column, raw_text: Column) -> Column:
    """Figures (by field) whose whole digits stand in no cited quote and not in the amount's own text."""
    text = F.replace(F.replace(F.array_join(quotes, " "), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    own = F.replace(F.coalesce(raw_text, F.lit("")), F.lit(","), F.lit(""))
    missing = lambda v: v.isNotNull() & (F.size(quotes) > 0) & ~F.contains(text, F.substring_index(v, ".", 1)) & ~F.contains(own, F.substring_index(v, ".", 1))
    return F.array_compact(F.array(*(F.when(missing(v), F.lit(f"amount.value_not_in_quote:{f}")) for f, v in values.items())))


def uncited(rows: DataFrame, record: Column, path: Column, ids: Column, required: Column, code: str = "evidence.missing") -> DataFrame:
    """Findings for things that need evidence and cite none."""
    return found(rows.where(required & (F.size(F.coalesce(ids, F.array().cast("array<string>"))) == 0)), record, path, F.lit(code))


def cycle_codes(starts_on: Column, ends_on: Column) -> Column:
    return F.array_compact(F.array(F.when(dates.iso_date(starts_on) > dates.iso_date(ends_on), "cycle.dates_inverted")))


#: Reviews after which a record may be published, and the seconds by which clocks may differ.
REVIEWED = ("machine_checked", "human_reviewed")
AHEAD = 5 * 60


def status_codes(r: Column, mode: str | None = None, now: Column | None = None) -> Column:
    """What a record's status, origin and times violate, as ``code:field``.

    r: a struct with id, review_status, publication_status, extraction_method, is_demo, review (null if there is no
    review), last_fetched_at and last_verified_at (ISO texts). mode: live or demo, if the data must be so. now: epoch seconds.
    """
    reviewed, published = r.review_status.isin(*REVIEWED), r.publication_status == "published"
    checks = [
        F.when((r.review_status == "human_reviewed") & r.review.isNull(), "review.record_missing:review"),
        F.when((F.coalesce(r.last_verified_at, F.lit("")) != "") & ~reviewed, "verification.status_mismatch:last_verified_at"),
        F.when(published & ~reviewed, "publication.not_reviewed:publication_status"),
        F.when((r.extraction_method == "llm") & (published | (r.review_status == "machine_checked")), "publication.llm_unreviewed:extraction_method"),
        F.when(r.is_demo != (r.extraction_method == "demo_synthetic"), "demo.method_mismatch:is_demo"),
        F.when(r.is_demo & ~r.id.startswith("demo_"), "demo.id_prefix:id"),
    ]
    if mode is not None:
        checks.append(F.when(r.is_demo, "mode.demo_in_live:is_demo") if mode == "live" else F.when(~r.is_demo, "mode.live_in_demo:is_demo"))
    if now is not None:
        checks += [F.when(F.unix_seconds(r[f].try_cast("timestamp")) > now + AHEAD, f"time.in_future:{f}") for f in ("last_fetched_at", "last_verified_at")]
    return F.array_compact(F.array(*checks))


def schema_codes(values: dict[str, Column], required: Sequence[str] = (), enums: dict[str, Sequence[str]] | None = None, patterns: dict[str, str] | None = None, most: dict[str, int] | None = None) -> Column:
    """What fields violate of a closed schema: required, enum, pattern and length, each as code:field."""
    checks = [F.when(values[f].isNull(), F.lit(f"schema.required:{f}")) for f in required]
    checks += [F.when(values[f].isNotNull() & ~values[f].isin(*allowed), F.lit(f"schema.enum:{f}")) for f, allowed in (enums or {}).items()]
    checks += [F.when(~values[f].rlike(p), F.lit(f"schema.pattern:{f}")) for f, p in (patterns or {}).items()]
    checks += [F.when(F.length(values[f]) > n, F.lit(f"schema.length:{f}")) for f, n in (most or {}).items()]
    return F.array_compact(F.array(*checks))


def summary(records: DataFrame, issues: DataFrame, record: str) -> DataFrame:
    """One row: records, valid and invalid ones (with an error), and numbers of errors and warnings."""
    bad = issues.where("severity = 'error'").select(F.col("record_id").alias(record)).distinct().withColumn("bad", F.lit(True))
    marked = records.select(F.col(record).cast("string").alias(record)).join(bad, record, "left")
    counts = marked.agg(F.count("*").alias("total"), F.count_if(F.col("bad").isNull()).alias("valid"), F.count_if("bad").alias("invalid"))
    return counts.crossJoin(F.broadcast(issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))))


def histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


def related_path(a: Column, b: Column) -> Column:
    """Whether two JSON pointers are equal or one leads to the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def pointer(*tokens: Column) -> Column:
    return F.concat(*(F.concat(F.lit("/"), F.replace(F.replace(t.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for t in tokens))


def stamped(records: DataFrame, issues: DataFrame, record: str, as_of: Column, review: str = "review_status", verified: str = "last_verified_at") -> DataFrame:
    """Records whose verification is as_of if they are reviewed and without an error, else as it was."""
    bad = issues.where("severity = 'error'").select(F.col("record_id").alias(record)).distinct().withColumn("_bad", F.lit(True))
    passed = F.col("_bad").isNull() & F.col(review).isin("machine_checked", "human_reviewed")
    return records.join(bad, record, "left").withColumn(verified, F.when(passed, as_of).otherwise(F.col(verified))).drop("_bad")
