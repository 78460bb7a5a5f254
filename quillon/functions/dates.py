"""Deadlines as windows of instants.

A deadline closes somewhere in [earliest, latest]; it is closed from ``latest`` on, so no ambiguity closes it early: an
unknown zone, an abbreviation that contradicts its region's clock that day, and a repeated or skipped local hour widen
the window. A date without a time closes at the end of its local day. All instants are computed from epoch seconds and
don't depend on the session's time zone.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written zones. Abbreviations with minutes from UTC and the region in which they are used.
ABBREVIATIONS = {
    "EST": (-300, "America/Toronto"),
    "EDT": (-240, "America/Toronto"),
    "CST": (-360, "America/Winnipeg"),
    "CDT": (-300, "America/Winnipeg"),
    "MST": (-420, "America/Edmonton"),
    "MDT": (-360, "America/Edmonton"),
    "PST": (-480, "America/Vancouver"),
    "PDT": (-420, "America/Vancouver"),
    "AST": (-240, "America/Halifax"),
    "ADT": (-180, "America/Halifax"),
    "NST": (-210, "America/St_Johns"),
    "NDT": (-150, "America/St_Johns"),
    "UTC": (0, None),
    "GMT": (0, None),
}
GENERIC = {
    "eastern time": "America/Toronto",
    "eastern": "America/Toronto",
    "et": "America/Toronto",
    "central time": "America/Winnipeg",
    "ct": "America/Winnipeg",
    "mountain time": "America/Edmonton",
    "mt": "America/Edmonton",
    "pacific time": "America/Vancouver",
    "pt": "America/Vancouver",
    "atlantic time": "America/Halifax",
    "newfoundland time": "America/St_Johns",
}
DAY = 86400


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def iso_date(text: Column) -> Column:
    """Date of a ``YYYY-MM-DD`` string, null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def utc_text(instant: Column) -> Column:
    """``2026-10-07T12:00:00Z``."""
    s = F.unix_seconds(instant)
    return F.concat(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def seconds_of(day: Column) -> Column:
    return F.unix_date(day).cast("long") * DAY


def day_start(day: Column) -> Column:
    """When a day first begins anywhere (UTC+14), in epoch seconds."""
    return seconds_of(day) - 14 * 3600


def day_end(day: Column) -> Column:
    """When a day has ended everywhere (UTC-12), in epoch seconds."""
    return seconds_of(day) + DAY + 12 * 3600


def _offset(local: Column, zone: Column) -> Column:
    """Seconds that a zone is ahead of UTC at a local time, as Spark reads it."""
    return local - F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


REGION_NAMES = sorted(x for x in zoneinfo.available_timezones() if "/" in x)


def zone_of(text: Column, day: Column) -> Column:
    """How a written zone is read on a day: status (iana, generic, fixed, ambiguous, unknown), region, minutes."""

    def read(x):
        clash = bound(seconds_of(x.day) + DAY // 2, lambda noon: _offset(noon, x.usual) != x.minutes * 60)
        status = F.when(x.named, "iana").when(x.generic.isNotNull(), "generic").when(x.minutes.isNull(), "unknown").when(x.usual.isNotNull() & clash, "ambiguous").otherwise("fixed")
        return bound(F.struct(status.alias("status"), x.alias("x")), where)

    def where(y):
        region = F.when(y.status == "iana", F.when(F.upper(y.x.plain) == "UTC", F.lit("UTC")).otherwise(y.x.plain)).when(y.status == "generic", y.x.generic).when(y.status == "ambiguous", y.x.usual)
        return F.struct(y.status.alias("status"), region.alias("region"), F.when(y.status.isin("fixed", "ambiguous"), y.x.minutes).alias("minutes"))

    def looked_up(plain):
        return F.struct(
            plain.alias("plain"),
            day.alias("day"),
            (plain.isin(*REGION_NAMES) | (F.upper(plain) == "UTC")).alias("named"),
            _lookup(GENERIC, F.lower(plain)).alias("generic"),
            _lookup({k: v[0] for k, v in ABBREVIATIONS.items()}, F.upper(plain)).alias("minutes"),
            _lookup({k: v[1] for k, v in ABBREVIATIONS.items() if v[1]}, F.upper(plain)).alias("usual"),
        )

    # Most deadlines have no zone: nothing is looked up for them.
    nothing = F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("int").alias("minutes"))
    return bound(F.trim(F.coalesce(text, F.lit(""))), lambda plain: F.when(plain == "", nothing).otherwise(bound(looked_up(plain), read)))


def close_window(kind: Column, date: Column, local_time: Column, zone: Column) -> Column:
    """earliest, latest (epoch seconds), flags and basis of a deadline; null unless it is a date or datetime with a valid date."""

    def local_of(d):
        hms = F.split(F.trim(local_time), ":")
        stated = F.get(hms, 0).try_cast("int") * 3600 + F.get(hms, 1).try_cast("int") * 60 + F.coalesce(F.get(hms, 2).try_cast("double").cast("int"), F.lit(0))
        timed = F.coalesce(F.trim(local_time), F.lit("")) != ""
        # The clock is read at the stated time; the stated minute or second passes after that, also where the clock changes at its end.
        local, past = seconds_of(d) + F.when(timed, stated).otherwise(DAY), F.when(timed, F.when(F.size(hms) == 2, 60).otherwise(1)).otherwise(0)
        return F.struct(local.alias("local"), past.alias("past"), timed.alias("timed"), zone_of(zone, d).alias("zone"))

    def readings(x):
        region = F.coalesce(x.zone.region, F.lit("UTC"))
        # The two readings of a repeated or skipped hour are those by the clock a day before and a day after.
        first, second = x.local - _offset(x.local - DAY, region), x.local - _offset(x.local + DAY, region)
        return F.struct(x.alias("x"), region.alias("region"), first.alias("first"), second.alias("second"))

    def told(r):
        back = lambda instant: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(instant), r.region))
        # On most days both readings are one. Where one gives the local time back and the other doesn't, the clock changed within a day, but not in this hour.
        same = r.first == r.second
        both = same | ((back(r.first) == r.x.local) == (back(r.second) == r.x.local))
        settled = lambda: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(r.x.local), r.region))
        one, two = F.when(both, r.first).otherwise(settled()), F.when(both, r.second).otherwise(settled())
        return F.struct(r.x.alias("x"), one.alias("one"), two.alias("two"), (~same & both).alias("changed"), (~same & (back(r.first) == r.x.local)).alias("repeated"))

    def window(t):
        x, status, region = t.x, t.x.zone.status, t.x.zone.region
        options = F.array(F.when(region.isNotNull(), t.one), F.when(region.isNotNull(), t.two), x.local - x.zone.minutes * 60, F.when(status == "unknown", x.local - 14 * 3600), F.when(status == "unknown", x.local + 12 * 3600))
        changed = region.isNotNull() & t.changed
        flags = F.array_sort(F.array_compact(F.array(F.when(status == "unknown", "timezone_unknown"), F.when(status == "ambiguous", "timezone_ambiguous"), F.when(changed & t.repeated, "dst_repeated_local_time"), F.when(changed & ~t.repeated, "dst_skipped_local_time"))))
        return bound(options, lambda o: F.when(x.local.isNotNull(), F.struct((F.array_min(o) + x.past).alias("earliest"), (F.array_max(o) + x.past).alias("latest"), flags.alias("flags"), F.when(x.timed, "stated_time").otherwise("end_of_local_day").alias("basis"))))

    dated = F.when(kind.isin("date", "datetime"), iso_date(date))
    return bound(dated, lambda d: F.when(d.isNotNull(), bound(local_of(d), lambda x: bound(readings(x), lambda r: bound(told(r), window)))))


def state(window: Column, as_of: Column) -> Column:
    """closed, not_closed or closing_ambiguous at an instant (epoch seconds); unresolved without a window."""
    return F.when(window.isNull(), "unresolved").when(as_of >= window.latest, "closed").when(as_of < window.earliest, "not_closed").otherwise("closing_ambiguous")


def exact_close(window: Column) -> Column:
    """The closing instant as text, where there is only one."""
    return F.when(window.earliest == window.latest, utc_text(F.timestamp_seconds(window.latest)))


def as_of_seconds(text: str) -> int:
    """Epoch seconds of an instant; a date alone means noon UTC, a missing offset UTC."""
    from datetime import UTC, datetime

    text = text.strip()
    at = datetime.fromisoformat(text + "T12:00:00" if len(text) == 10 else text.replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def stated_dates(text: Column) -> Column:
    """Dates written as ``Month D, YYYY``; invalid ones are left out."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    found = F.regexp_extract_all(text, F.lit(rf"\b((?:{months})\s+\d{{1,2}},\s+\d{{4}})"), 1)
    return F.filter(F.transform(found, lambda x: F.to_date(F.try_to_timestamp(F.regexp_replace(x, r"\s+", " "), F.lit("MMMM d, yyyy")))), lambda d: d.isNotNull())


def next_annual(month: Column, day: Column, today: Column) -> Column:
    """The first day from today on with that month and day; 29 February waits for a leap year within four (in eight around a century)."""
    years = [F.year(today) + k for k in range(9)]
    made = [F.concat_ws("-", y.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date") for y in years]
    return reduce(lambda rest, d: F.when(d >= today, d).otherwise(rest), reversed(made), F.lit(None).cast("date"))


def valid_annual_day(month: Column, day: Column) -> Column:
    """Whether a month has that day; February has 29."""
    return F.concat_ws("-", F.lit("2000"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date").isNotNull()


def stale(verified_at: Column, as_of: Column, days: int) -> Column:
    """Whether a verification is older than so many days (both epoch seconds); false if there is none."""
    return F.coalesce(as_of - verified_at > days * DAY, F.lit(False))
