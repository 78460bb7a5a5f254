import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import dates, hashing, money, text, urls


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_folds(spark):
    row = one(spark, text.fold(F.lit("MÉTIS Çà")), text.fold_exact(F.lit("Straße ΑΣ")), text.search_fold(F.lit("“Ｆｕｌｌ”  Métis​")), text.collapse(F.lit(" a \n b ")))
    assert list(row) == ["metis ca", "strasse ασ", '"full" metis', "a b"]


@settings(max_examples=30, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=12))
def test_native_fold_agrees_with_unicode_on_latin_letters(s):
    table = dict(zip(text.MARKED, text.BASE))
    want = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    got = "".join(table.get(c, c) for c in s.lower())
    assert unicodedata.normalize("NFD", got).encode("ascii", "ignore") == want.encode("ascii", "ignore")


def test_phrase_and_terms_differ(spark):
    t = F.lit("Bourse des Métis du nord")
    row = one(spark, text.contains_phrase(t, "metis DU"), text.contains_phrase(t, "nord bourse"), text.contains_terms(t, "nord bourse"), text.contains_terms(t, "nord sud"), text.contains_phrase(F.lit(None).cast("string"), ""))
    assert list(row) == [True, False, True, False, True]


def test_ids_and_sentences(spark):
    long = "x" * 120
    row = one(spark, text.slug(F.lit("  Été — à Québec! ")), text.slug(F.lit("***")), text.stable_id(F.lit("short")), F.length(text.stable_id(F.lit(long))), text.first_sentence(F.lit("One. Two.")), text.formula_safe(F.lit(" =1+1")), text.acronym(F.lit("Bank of the North")))
    assert list(row) == ["ete_a_quebec", "item", "short", 100, "One.", "' =1+1", "BN"]


def test_money(spark):
    row = one(spark, money.canonical_decimal(F.lit("5000.00")), money.canonical_decimal(F.lit("100")), money.decimal(F.lit("5e3")), money.decimal(F.lit("-1")), *(money.from_text(F.lit(s))["kind"] for s in ("$1,000", "Up to $2,500", "$500 - $1,000", "Varies")))
    assert list(row) == ["5000", "100", None, None, "fixed", "maximum", "range", "unspecified"]


@pytest.mark.parametrize(
    "date,time,zone,earliest,latest,flags",
    [
        ("2026-10-07", None, "America/Vancouver", "2026-10-08T07:00:00Z", "2026-10-08T07:00:00Z", []),
        ("2026-10-07", None, "", "2026-10-07T10:00:00Z", "2026-10-08T12:00:00Z", ["timezone_unknown"]),
        ("2026-07-15", "23:59", "EST", "2026-07-16T04:00:00Z", "2026-07-16T05:00:00Z", ["timezone_ambiguous"]),
        ("2026-11-01", "01:29", "America/Toronto", "2026-11-01T05:30:00Z", "2026-11-01T06:30:00Z", ["dst_repeated_local_time"]),
        ("2026-03-08", "02:29", "America/Toronto", "2026-03-08T06:30:00Z", "2026-03-08T07:30:00Z", ["dst_skipped_local_time"]),
    ],
)
def test_close_windows(spark, date, time, zone, earliest, latest, flags):
    w = dates.close_window(F.lit("datetime"), F.lit(date), F.lit(time).cast("string"), F.lit(zone))
    row = spark.range(1).select(w.alias("w")).select(dates.utc_text(F.timestamp_seconds("w.earliest")), dates.utc_text(F.timestamp_seconds("w.latest")), "w.flags").first()
    assert list(row) == [earliest, latest, flags]


def test_unknown_zone_never_closes_early(spark):
    none = F.lit(None).cast("string")
    at = lambda t: one(spark, dates.state(dates.close_window(F.lit("date"), F.lit("2026-10-07"), none, none), F.lit(dates.as_of_seconds(t))))[0]
    assert [at("2026-10-07T09:59:00Z"), at("2026-10-07T12:00:00Z"), at("2026-10-08T12:00:00Z")] == ["not_closed", "closing_ambiguous", "closed"]


def test_dates_in_text_and_yearly(spark):
    day = lambda s: F.lit(s).cast("date")
    row = one(spark, dates.stated_dates(F.lit("By March 3, 2026 or February 30, 2026.")), dates.next_annual(F.lit(2), F.lit(29), day("2026-03-01")), dates.valid_annual_day(F.lit(2), F.lit(29)), dates.valid_annual_day(F.lit(2), F.lit(30)))
    assert [str(x) for x in row[0]] == ["2026-03-03"] and str(row[1]) == "2028-02-29" and row[2] and not row[3]


def test_urls(spark):
    row = one(spark, urls.canonical(F.lit("HTTPS://Example.org:443/Detail?id=7&utm_source=x&wbdisable=true#top")), urls.canonical(F.lit("https://u:p@example.org/")), urls.refusal(F.lit("http://127.0.0.1/")), urls.refusal(F.lit("http://localhost/")), urls.refusal(F.lit("ftp://a.org")), urls.refusal(F.lit("https://a.org/x")))
    assert list(row) == ["https://example.org/Detail?id=7&wbdisable=true", None, "private", "private", "scheme", None]


def test_canonical_json(spark):
    row = one(spark, hashing.canonical_json(F.lit('{"b": 1, "a": "é"}')), hashing.canonical_json(F.lit("{")), hashing.has_duplicate_keys(F.lit('{"a": {"b": 1, "b": 2}}')))
    assert list(row) == ['{"a":"é","b":1}', None, True]


def test_windows_of_zones_and_hours(spark):
    """Whole days, stated times, generic and abbreviated zones, repeated and skipped hours."""
    cases = [
        ("2026-10-07", None, "America/Vancouver", "2026-10-08T07:00:00Z", "2026-10-08T07:00:00Z", "", "end_of_local_day"),
        ("2026-10-07", None, None, "2026-10-07T10:00:00Z", "2026-10-08T12:00:00Z", "timezone_unknown", "end_of_local_day"),
        ("2026-07-15", "23:59", "Eastern Time", "2026-07-16T04:00:00Z", "2026-07-16T04:00:00Z", "", "stated_time"),
        ("2026-07-15", "23:59", "EST", "2026-07-16T04:00:00Z", "2026-07-16T05:00:00Z", "timezone_ambiguous", "stated_time"),
        ("2026-01-15", "12:00:00", "PST", "2026-01-15T20:00:01Z", "2026-01-15T20:00:01Z", "", "stated_time"),
        ("2026-11-01", "01:30", "America/Toronto", "2026-11-01T05:31:00Z", "2026-11-01T06:31:00Z", "dst_repeated_local_time", "stated_time"),
        ("2026-03-08", "02:29", "America/Toronto", "2026-03-08T06:30:00Z", "2026-03-08T07:30:00Z", "dst_skipped_local_time", "stated_time"),
    ]
    from pyspark.sql import functions as F

    from quillon.functions import dates

    d = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, date string, local_time string, zone string").withColumn("w", dates.close_window(F.lit("datetime"), F.col("date"), F.col("local_time"), F.col("zone")))
    rows = d.select("date", "local_time", "zone", dates.utc_text(F.timestamp_seconds("w.earliest")), dates.utc_text(F.timestamp_seconds("w.latest")), F.array_join("w.flags", ","), "w.basis", "i").orderBy("i").collect()
    assert [tuple(r)[:7] for r in rows] == cases


@pytest.mark.parametrize(
    "date,time,earliest,latest,flags",
    [
        ("2030-11-03", "01:59", "2030-11-03T06:00:00Z", "2030-11-03T07:00:00Z", ["dst_repeated_local_time"]),
        ("2030-11-03", "00:59", "2030-11-03T05:00:00Z", "2030-11-03T05:00:00Z", []),
        ("2030-03-10", "01:59", "2030-03-10T07:00:00Z", "2030-03-10T07:00:00Z", []),
        ("2030-03-10", "02:59", "2030-03-10T07:00:00Z", "2030-03-10T08:00:00Z", ["dst_skipped_local_time"]),
    ],
)
def test_last_minute_before_a_change_of_clocks(spark, date, time, earliest, latest, flags):
    w = dates.close_window(F.lit("datetime"), F.lit(date), F.lit(time), F.lit("Eastern Time"))
    row = spark.range(1).select(w.alias("w")).select(dates.utc_text(F.timestamp_seconds("w.earliest")), dates.utc_text(F.timestamp_seconds("w.latest")), "w.flags").first()
    assert list(row) == [earliest, latest, flags]
