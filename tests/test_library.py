import json

from pyspark.sql import functions as F

from quillon.functions import dates
from quillon.operators import availability, documents, matching, merge, publishing, rules, search, statistics, validation
from quillon.operators import records as nested_records
from quillon.sources import tables

D = "array<struct<kind:string,date:string,local_time:string,timezone:string>>"


def pred(field, op, value, **more):
    return {"type": "predicate", "field": field, "op": op, "value": value, **more}


def matched(spark, tree, **profile):
    nodes = rules.flatten(spark.createDataFrame([("r", json.dumps(tree))], "id string, tree string"), "id", "tree")
    kinds = {k: v[0] for k, v in rules.FIELDS.items()}
    schema = ", ".join(f"{k} {'array<string>' if kinds.get(k) == 'set' else 'string'}" for k in kinds)
    who = spark.createDataFrame([("p", *(profile.get(k) for k in kinds), profile.get("gpa_scale"))], f"profile string, {schema}, gpa_scale string")
    row = matching.matched(nodes, who, "profile", kinds, "gpa_scale").first()
    return row.match_status, row.missing_fields


def test_kleene_groups(spark):
    bc, on = pred("residence_province", "eq", "BC"), pred("residence_province", "eq", "ON")
    level = pred("education_level", "in", ["college", "masters"])
    both = {"mandatory": [{"type": "all", "children": [bc, level]}]}
    either = {"mandatory": [{"type": "any", "children": [on, level]}]}
    assert matched(spark, both, residence_province="bc", education_level="College")[0] == "potential_fit"
    assert matched(spark, both, residence_province="ON")[0] == "not_eligible"
    assert matched(spark, both, residence_province="BC") == ("needs_information", ["education_level"])
    assert matched(spark, either, residence_province="BC") == ("needs_information", ["education_level"])
    assert matched(spark, either, residence_province="ON")[0] == "potential_fit"


def test_sets_scales_and_names(spark):
    identity = {"mandatory": [pred("indigenous_identity", "overlaps", ["metis"])]}
    assert matched(spark, identity, indigenous_identity=[])[0] == "not_eligible"
    assert matched(spark, identity) == ("needs_information", ["indigenous_identity"])
    gpa = {"mandatory": [pred("gpa", "gte", "3.0", scale="4.0")]}
    assert matched(spark, gpa, gpa="3.4", gpa_scale="4.00")[0] == "potential_fit"
    assert matched(spark, gpa, gpa="80", gpa_scale="100")[0] == "needs_information"
    soft = {"mandatory": [pred("home_region", "eq", "North  Shore")]}
    assert matched(spark, soft, home_region="north shore")[0] == "potential_fit"
    assert matched(spark, soft, home_region="south")[0] == "needs_provider_confirmation"


def test_unstructured_conditions_never_pass(spark):
    tree = {"mandatory": [pred("residence_province", "eq", "BC")], "unstructured": [{"text": "as the board decides"}]}
    assert matched(spark, tree, residence_province="BC")[0] == "needs_provider_confirmation"
    assert matched(spark, tree, residence_province="ON")[0] == "not_eligible"


def test_invalid_rules_are_unknown(spark):
    df = spark.createDataFrame([("a", json.dumps({"mandatory": [{"type": "all", "children": []}]})), ("b", json.dumps({"mandatory": [pred("nothing", "eq", "x"), pred("gpa", "eq", "3")]})), ("c", "{")], "id string, tree string")
    got = {(r.rule_id, r.kind, r.error) for r in rules.flatten(df, "id", "tree").collect()}
    assert got == {("a", "unknown", "rule.empty_group"), ("b", "unknown", "rule.unknown_field"), ("b", "unknown", "rule.bad_op"), ("c", "unknown", None)}


def status(spark, starts, ends, deadlines, as_of="2026-06-15"):
    df = spark.createDataFrame([(starts, ends, deadlines)], f"s string, e string, d {D}")
    return df.select(availability.availability(F.col("s"), F.col("e"), F.col("d"), F.lit(dates.as_of_seconds(as_of))).alias("a")).first().a


def test_availability(spark):
    ahead = [("date", "2026-07-01", None, "America/Toronto")]
    assert status(spark, None, None, ahead).status == "unknown"
    assert status(spark, "2026-01-01", None, ahead).status == "open"
    assert status(spark, "2026-12-01", None, ahead).status == "upcoming"
    assert status(spark, None, None, [("date", "2026-01-01", None, None)]).status == "closed"
    assert status(spark, None, None, [("rolling", None, None, None)]).status == "open"
    assert status(spark, None, None, [("local_administrator", None, None, None)]).status == "contact_administrator"
    assert status(spark, None, None, []).flags == ["deadline_unknown"]
    assert status(spark, None, None, None).status == "unknown"


def test_key_order_puts_prefixes_first(spark):
    keys = spark.createDataFrame([("2026",), ("2026-27",), ("2025",)], "k string")
    assert [r.k for r in keys.orderBy(availability.key_order(F.col("k"))).collect()] == ["2026", "2026-27", "2025"]


RECORDS = "id string, title string, provider string, type string, community array<string>, province string, amount double, amount_kind string, renewable boolean, deadline_kind string, display_order int, education_levels array<string>"


def records(spark):
    return spark.createDataFrame(
        [
            ("a", "Métis bursary", "P1", "Scholarship", ["Métis"], "Ontario", 4000.0, "fixed", True, "date", 20, ["college"]),
            ("b", "North award", "P2", "Scholarship", ["Inuit", "Métis"], "all", None, None, None, None, 10, []),
            ("c", "Skills program", "P1", "Program", ["First Nations"], None, 9000.0, "maximum", False, "rolling", None, None),
        ],
        RECORDS,
    )


def test_filters_and_unknown_policy(spark):
    r = records(spark)
    ids = lambda **f: [x.id for x in search.search(r, search.Filters(**f)).collect()]
    assert ids() == ["b", "a", "c"]
    assert ids(q="metis BURSARY") == ["a"] and ids(communities=("Métis",)) == ["b", "a"]
    assert ids(provinces=("Ontario",)) == ["b", "a", "c"] and ids(provinces=("Ontario",), include_unknown=False) == ["b", "a"]
    assert ids(scope="unspecified") == ["c"] and ids(scope="regional") == ["a"] and ids(scope="national") == ["b"]
    assert ids(amount_band="high") == ["c"] and ids(amount_band="unknown") == ["b"]
    assert ids(renewable="yes") == ["b", "a"] and ids(renewable="unknown") == ["b"] and ids(renewable="no", include_unknown=False) == ["c"]
    assert ids(any_of={"education_levels": ("college",)}) == ["b", "a", "c"] and ids(any_of={"education_levels": ("college",)}, include_unknown=False) == ["a"]
    assert ids(deadline_kind="rolling", include_unknown=False) == ["c"] and ids(sort="amount") == ["c", "a", "b"]


def test_statistics(spark):
    o = statistics.overview(records(spark), "province", "amount").first()
    assert (o.total, o.national_count, o.regional_count, o.unspecified_count, o.amount_listed, o.amount_highest) == (3, 1, 1, 1, 2, 9000.0)
    by = {r.name: (r.regional_count, r.reach_count) for r in statistics.by_region(records(spark), "province", statistics.regions(spark)).collect()}
    assert len(by) == 13 and by["Ontario"] == (1, 2) and by["Yukon"] == (0, 1)


def test_chart_distributions(spark):
    x = spark.createDataFrame([(5000.0,), (5000.0,), (10000.0,)], "x double")
    assert [(r.x, round(r.share, 4)) for r in statistics.ecdf(x, "x").orderBy("x").collect()] == [(5000.0, 0.6667), (10000.0, 1.0)]
    assert statistics.quantiles(spark.createDataFrame([(5000.0,), (53000.0,)], "x double"), "x", (0.5,)).first()[0] == 29000.0
    counts = spark.createDataFrame([("a", 27), ("b", 1), ("c", 3), ("d", 1), ("e", 497)], "k string, n int")
    assert statistics.waffle(counts, "k", "n").agg(F.sum("tiles")).first()[0] == 100
    assert statistics.density(spark.createDataFrame([(5.0,)], "x double"), "x").count() == 0


def test_import_is_idempotent_and_ordered(spark):
    schema = "id string, v string, fetched int"
    first = spark.createDataFrame([("a", "1", 5), ("b", "1", 5)], schema)
    empty = spark.createDataFrame([], schema + ", version int")
    plan = merge.plan(first, empty, "id", ["v"], "fetched")
    store = merge.applied(empty, first, plan, "id").cache()
    assert {r.action for r in plan.collect()} == {"created"}
    assert {r.action for r in merge.plan(first, store, "id", ["v"], "fetched").collect()} == {"unchanged"}
    later = spark.createDataFrame([("a", "2", 6), ("b", "2", 4)], schema)
    assert {r.id: (r.action, r.version) for r in merge.plan(later, store, "id", ["v"], "fetched").collect()} == {"a": ("updated", 2), "b": ("pending_review", 1)}


def test_listed_regions_and_communities(spark):
    s = ["Province/territory: Ontario. x", "Province/territory: National.", "Province/territory: Mars.", None]
    df = spark.createDataFrame([(x,) for x in s], "s string")
    assert [r[0] for r in df.select(publishing.listed_region(F.col("s"))).collect()] == ["Ontario", "all", None, None]
    g = ["Indigenous group: Métis; First Nations.", "Indigenous group: All Indigenous People.", "Indigenous group: Inuit; Others.", "none"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in g], "s string").select(publishing.listed_communities(F.col("s"))).collect()]
    assert got == [["First Nations", "Métis"], ["First Nations", "Inuit", "Métis"], None, None]


def test_timing_labels(spark):
    kinds = "array<struct<kind:string,date:string,raw_text:string>>"
    rows = [([("date", "2026-11-03", None), ("date", "2026-01-09", None)],), ([("annual_rule", None, " March 1 ")],), ([("rolling", None, None)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, f"d {kinds}").select(publishing.timing(F.col("d"))).collect()]
    assert got == ["Apply by Jan 9, 2026 or Nov 3, 2026", "Due every year — Mar 1", "Rolling intake", "Confirm the next deadline"]


PAGE = "<html><head><title> A  page </title></head><body><nav><a href='/n'>Nav</a><p>skip</p></nav><h1>Top</h1><p>First <b>bold</b> text<p>Second<ul><li>One<li>Two</ul><table><tr><td>a</td><td>b</td></tr></table><h2>Sub</h2><a href='x?y=1'>Link</a></body>"


def test_html_blocks_and_links(spark):
    df = spark.createDataFrame([(1, PAGE, "https://e.org/d/")], "id int, html string, url string")
    got = [(r.kind, r.text) for r in documents.blocks(df, "id", "html", "url").orderBy("pos").collect()]
    assert got == [("heading", "Top"), ("paragraph", "First bold text"), ("paragraph", "Second"), ("list_item", "One"), ("list_item", "Two"), ("table_row", "a | b"), ("heading", "Sub"), ("paragraph", "Link")]
    assert {(r.href, r.heading) for r in documents.links(df, "id", "html", "url").collect()} == {("https://e.org/n", ""), ("https://e.org/d/x?y=1", "Sub")}


def test_quotes_are_located(spark):
    q = spark.createDataFrame([("q1", 1, "“two  words”"), ("q2", 1, "absent")], "id string, doc int, quote string")
    b = spark.createDataFrame([(1, 0, "nothing"), (1, 1, 'has "two words" here')], "doc int, pos int, text string")
    got = {r.id: (r.paragraph_index, r.text_start, r.text_end) for r in documents.located(q, b, "doc").collect()}
    assert got == {"q1": (1, 4, 15), "q2": (None, None, None)}


def test_crawl_is_breadth_first(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "source string, target string")
    got = {r.url: r.depth for r in documents.reachable(links, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_lines_and_aliases(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('﻿{"a": 1}\n\n{"a": 1, "a": 2}\n{', encoding="utf-8")
    lines = tables.parsed_lines(tables.numbered_lines(spark, str(tmp_path / "x.jsonl")), "a int")
    assert [(r.line_no, r.issue, r.record and r.record.a) for r in lines.orderBy("line_no").collect()] == [(1, None, 1), (3, "json.duplicate_key", None), (4, "json.invalid", None)]
    rows = spark.createDataFrame([("1", "North  College", ["NC"]), ("2", "New College", ["nc", "new"])], "id string, name string, aliases array<string>")
    assert {r.alias for r in tables.institutions(rows).collect()} == {"north college", "new college", "new"}


def test_findings(spark):
    r = spark.createDataFrame([("a", "x"), ("b", None)], "id string, kind string")
    codes = validation.schema_codes({"kind": F.col("kind")}, required=["kind"], enums={"kind": ["y"]})
    issues = validation.exploded(r, F.col("id"), codes, F.lit(""))
    assert {(i.record_id, i.path, i.code) for i in issues.collect()} == {("a", "/kind", "schema.enum"), ("b", "/kind", "schema.required")}
    s = validation.summary(r, issues, "id").first()
    assert (s.total, s.valid, s.invalid, s.errors) == (2, 0, 2, 2)


def test_running_counts_of_heavy_tails(spark):
    values = [float(2**i) for i in range(40) for _ in range(i % 3 + 1)] + [0.5] * 50 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in statistics.running(df, "x").orderBy("x").collect()]
    known = sorted(v for v in values if v is not None)
    assert got == [(v, known.count(v), sum(u <= v for u in known), len(known)) for v in sorted(set(known))]
    assert statistics.running(df.where("false"), "x").count() == 0
    assert statistics.quantiles(df.where("x < 0"), "x", (0.5,)).first().q50 is None


def test_superseded_by_key_or_by_title(spark):
    listed = spark.createDataFrame([("a", "t", "north college"), ("b", "t", "college"), ("c", "t", "other"), ("d", "u", "x"), ("e", None, "college"), ("f", "t", None), ("g", "", "college")], "id string, title string, provider string")
    preferred = spark.createDataFrame([("d", "v", "y"), ("p", "t", "college"), ("q", "t", "college"), ("r", None, "college"), ("s", "t", None)], "id string, title string, provider string")
    assert sorted(r.id for r in merge.superseded(listed, preferred, "id", "title", "provider").collect()) == ["a", "b", "d"]


def test_views_share_the_windows_of_availability(spark):
    deadlines = [("date", "2026-03-08", None, "America/Toronto"), ("datetime", "2026-11-01", "01:30", "America/Toronto"), ("rolling", None, None, None)]
    df = spark.createDataFrame([(deadlines,), ([],), (None,)], "d array<struct<kind:string,date:string,local_time:string,timezone:string>>")
    as_of, none, d = F.lit(1_770_000_000), F.lit(None).cast("string"), F.col("d")
    kept = df.withColumn("w", availability.windows_of(d))
    for plain, given in ((availability.availability(none, none, d, as_of), availability.availability(none, none, d, as_of, F.col("w"))), (nested_records.deadline_views(d, as_of), nested_records.deadline_views(d, as_of, F.col("w")))):
        assert [r.x for r in kept.select(given.alias("x")).collect()] == [r.x for r in df.select(plain.alias("x")).collect()]
