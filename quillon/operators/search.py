"""Faceted search over a read model: typed filters compiled to one predicate, with a policy for what a source doesn't say."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, fold



@dataclass(frozen=True)
class Columns:
    """Names of the read model's columns; None where a table has none."""

    id: str = "id"
    text: Sequence[str] = ("title", "fullTitle", "provider", "summary", "location", "type", "community")
    title: str = "title"
    provider: str = "provider"
    community: str | None = "community"
    type: str = "type"
    goals: str | None = "goals"
    province: str = "province"
    amount: str = "amount"
    amount_kind: str | None = "amount_kind"
    renewable: str | None = "renewable"
    deadline_kind: str | None = "deadline_kind"
    order: str | None = "display_order"
    lists: Sequence[str] = ("education_levels", "fields_of_study", "study_modes", "expenses")


@dataclass(frozen=True)
class Filters:
    q: str = ""
    communities: Sequence[str] = ()
    provinces: Sequence[str] = ()
    types: Sequence[str] = ()
    goals: Sequence[str] = ()
    scope: str = "all"
    amount_band: str = "all"
    amount_kind: str = "all"
    any_of: dict[str, Sequence[str]] = field(default_factory=dict)  #: values by name of a list column
    renewable: str = "all"
    deadline_kind: str = "all"
    providers: Sequence[str] = ()
    include_unknown: bool = True
    sort: str = "recommended"
    nationwide: str = "all"  #: the province of a record that applies everywhere
    amount_limit: int = 5000

    def __post_init__(self):
        for name, allowed in (("scope", ("all", "national", "regional", "unspecified")), ("amount_band", ("all", "listed", "unknown", "high", "under")), ("renewable", ("all", "yes", "no", "unknown")), ("sort", ("recommended", "amount", "alphabetical"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")


def overlaps(values: Column, wanted: Sequence[str]) -> Column:
    """Whether an array holds any wanted value; a null among them is no match, and no array is none."""
    return F.coalesce(F.size(F.array_intersect(values, F.array(*map(F.lit, wanted)))) > 0, F.lit(False))


def keeps(values: Column, wanted: Sequence[str], include_unknown: bool) -> Column:
    """overlaps, but a null or empty array is unknown."""
    return F.when(F.coalesce(F.size(values) <= 0, F.lit(True)), F.lit(include_unknown)).otherwise(overlaps(values, wanted))


def in_scope(province: Column, scope: str, nationwide: str = "all") -> Column:
    stated = F.coalesce(province != "", F.lit(False))
    return {"national": F.coalesce(province == nationwide, F.lit(False)), "regional": stated & (province != nationwide), "unspecified": ~stated}[scope]


def in_band(amount: Column, band: str, limit: int = 5000) -> Column:
    known = amount.isNotNull()
    return {"listed": known, "unknown": ~known, "high": known & (amount > limit), "under": known & (amount <= limit)}[band]


def predicate(filters: Filters, columns: Columns, kinds: dict[str, str]) -> Column:
    """All filters together; within one filter any value will do. kinds: the types of the columns."""
    f, col = filters, lambda name: F.col(name)
    as_list = lambda name: col(name) if kinds[name].startswith("array") else F.array_compact(F.array(col(name)))
    parts: list[Column] = []
    if f.q.strip():
        words = [F.array_join(col(c), " ") if kinds[c].startswith("array") else col(c) for c in columns.text if c in kinds]
        parts.append(contains_phrase(F.concat_ws(" ", *words), f.q))
    for wanted, name in ((f.communities, columns.community), (f.types, columns.type), (f.goals, columns.goals)):
        if wanted and name:
            parts.append(overlaps(as_list(name), wanted))
    province = col(columns.province) if columns.province in kinds else F.lit(None).cast("string")
    if f.provinces:
        unknown = F.coalesce(province, F.lit("")) == ""
        parts.append((~unknown & ((province == f.nationwide) | province.isin(*f.provinces))) | (unknown & F.lit(f.include_unknown)))
    if f.scope != "all":
        parts.append(in_scope(province, f.scope, f.nationwide))
    if f.amount_band != "all":
        parts.append(in_band(col(columns.amount), f.amount_band, f.amount_limit))
    if f.amount_kind != "all" and columns.amount_kind:
        parts.append(F.coalesce(col(columns.amount_kind), F.lit("unspecified")) == f.amount_kind)
    for name, wanted in f.any_of.items():
        if wanted:
            parts.append(keeps(col(name), wanted, f.include_unknown))
    if f.renewable != "all" and columns.renewable:
        have = col(columns.renewable)
        parts.append(have.isNull() if f.renewable == "unknown" else F.coalesce(have == F.lit(f.renewable == "yes"), F.lit(f.include_unknown)))
    if f.deadline_kind != "all" and columns.deadline_kind:
        kind = F.coalesce(col(columns.deadline_kind), F.lit("unspecified"))
        parts.append((kind == f.deadline_kind) | ((kind == "unspecified") & F.lit(f.include_unknown)))
    if f.providers:
        parts.append(F.coalesce(col(columns.provider).isin(*f.providers), F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def ordering(sort: str, columns: Columns) -> list[Column]:
    """The sort asked for; equal rows by id."""
    first = {"amount": F.desc_nulls_last(columns.amount), "alphabetical": fold(F.col(columns.title)), "recommended": F.coalesce(F.col(columns.order), F.lit(100)) if columns.order else F.lit(100)}[sort]
    return [first.asc() if sort != "amount" else first, F.col(columns.id).asc()]


def search(records: DataFrame, filters: Filters, columns: Columns = Columns(), limit: int | None = 24, offset: int = 0) -> DataFrame:
    """The page of matching records, in order; all of them without a limit."""
    if offset < 0 or limit is not None and not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100, offset 0 or more")
    found = records.where(predicate(filters, columns, dict(records.dtypes))).orderBy(*ordering(filters.sort, columns))
    return found if limit is None else found.offset(offset).limit(limit)


def listing(records: DataFrame, select: Column, order: Sequence[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page in a total order, with the number of all rows in a column ``total``."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100, offset 0 or more")
    found = records.where(select)
    page = found.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def facets(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value) of all distinct values."""
    return reduce(DataFrame.union, [records.select(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).where("value is not null").distinct() for c in columns])


def merged_filters(manual: Filters, suggested: Filters) -> Filters:
    """The suggestion, wherever a person hasn't set anything."""
    plain = Filters()
    return Filters(**{k: getattr(manual, k) if getattr(manual, k) != getattr(plain, k) else getattr(suggested, k) for k in plain.__dataclass_fields__})
