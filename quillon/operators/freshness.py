"""Freshness of a catalogue: how old, how complete and how verified its records are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates


def report(selected: DataFrame, as_of: Column, days: int, target: int = 20) -> DataFrame:
    """One row of counters over the selected cycles of records.

    selected: id, provider_id, opportunity_type, publication_status, review_status, verified_at (epoch seconds),
    cycle_key, availability (status, flags), kinds (of deadlines), amount_kind, mandatory and unstructured (numbers of
    conditions), documents, conflicts (numbers), group_id, is_demo.
    """
    has = lambda x: F.coalesce(x, F.lit(False))
    flag = lambda f: F.array_contains("availability.flags", f)
    kind = lambda k: F.array_contains("kinds", k)
    never, old = F.col("verified_at").isNull(), dates.stale(F.col("verified_at"), as_of, days)
    counters = {
        "published": F.col("publication_status") == "published",
        "draft": F.col("publication_status") == "draft",
        "archived": F.col("publication_status") == "archived",
        **{r: F.col("review_status") == r for r in ("pending", "machine_checked", "human_reviewed", "rejected")},
        **{t: F.col("opportunity_type") == t for t in ("award", "funding_channel", "award_collection")},
        "cycle_unknown": F.col("cycle_key") == "unspecified",
        "current_cycle_determined": F.col("cycle_key") != "unspecified",
        "deadline_unknown": flag("deadline_unknown"),
        "expired": F.col("availability.status") == "closed",
        "open": F.col("availability.status") == "open",
        "rolling": kind("rolling"),
        "local_administrator": kind("local_administrator"),
        "annual_rule_unconfirmed": kind("annual_rule"),
        "amount_unknown": F.col("amount_kind") == "unspecified",
        "eligibility_not_structured": (F.col("mandatory") == 0) | (F.col("unstructured") > 0),
        "records_with_unstructured_conditions": F.col("unstructured") > 0,
        "no_required_documents": F.col("documents") == 0,
        "records_with_conflicts": F.col("conflicts") > 0,
        "never_verified": never,
        "verification_stale": old,
    }
    counted = F.col("publication_status") == "published"
    real = counted & ~has(F.col("is_demo")) & (F.col("opportunity_type") != "award_collection")
    return selected.agg(
        F.count("*").alias("total"),
        *(F.count_if(has(c)).alias(k) for k, c in counters.items()),
        F.count_distinct(F.when(F.col("opportunity_type") != "award_collection", F.col("provider_id"))).alias("distinct_administrators"),
        F.count_distinct(F.when(F.col("group_id").isNotNull(), F.struct("group_id", "cycle_key"))).alias("shared_application_groups"),
        F.greatest(F.lit(0).cast("long"), target - F.count_if(has(real))).alias("shortfall"),
    )


def needs_attention(selected: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Ids of records that were never verified, or too long ago."""
    return selected.where(F.col("verified_at").isNull() | dates.stale(F.col("verified_at"), as_of, days)).select("id")


def discovery(observed: Column, declared: Column) -> Column:
    """Share of declared entries that were seen, to four places."""
    return F.bround(observed / declared, 4)
