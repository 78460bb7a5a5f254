"""Listing rules, their evaluation, and pages of groups."""

import json

from pyspark.sql import functions as F

from quillon.operators import evaluate, rules


def trees(spark, **by_id):
    return rules.flatten(spark.createDataFrame([(k, json.dumps(v)) for k, v in by_id.items()], "id string, tree string"), "id", "tree")


p = lambda field, op, value: {"type": "predicate", "field": field, "op": op, "value": value}


def test_only_listed_top_predicates_survive(spark):
    nodes = trees(spark, a={"mandatory": [p("residence_province", "eq", "BC"), {"type": "any", "children": [p("metis_citizen", "eq", True)]}, p("gpa", "gte", 3)]}, b={"mandatory": [p("gpa", "gte", 3)]}, c={"preferences": [p("metis_citizen", "eq", True)]}, d={"mandatory": [p("indigenous_identity", "overlaps", ["metis"]), p("study_status", "eq", "full_time")]})
    got = {r.rule_id: (r.kind, [(c.field, c.op, c["values"]) for c in r.children] if r.children else None) for r in evaluate.listing_rules(nodes).collect()}
    assert got["a"] == ("all", [("residence_province", "eq", ["British Columbia"]), (None, None, None), (None, None, None)])
    assert got["b"] == ("unknown", None) and got["c"] == ("unknown", None)
    assert got["d"] == ("all", [("communities", "overlaps", ["Métis"]), ("study_mode", "eq", ["full_time"])])


def test_evaluation(spark):
    rule = evaluate.listing_rules(trees(spark, two={"mandatory": [p("study_status", "eq", "full_time"), p("institution_id", "in", ["u1", "u2"])]}, open={"mandatory": [p("study_status", "eq", "full_time"), {"type": "unknown"}]}), rule_ids=spark.createDataFrame([("two",), ("open",), ("none",)], "rule_id string"))
    who = spark.createDataFrame([(1, "full_time", "u2"), (2, "part_time", None), (3, None, None), (4, "full_time", None)], "who int, study_mode string, institution_id string")
    got = {(r.who, r.rule_id): (r.match_status, r.missing) for r in evaluate.evaluated(rule, who, "who", ["study_mode", "institution_id"]).collect()}
    assert got[1, "two"] == ("potential_fit", []) and got[2, "two"] == ("not_eligible", []) and got[3, "two"] == ("needs_information", ["institution_id", "study_mode"]) and got[4, "two"] == ("needs_information", ["institution_id"])
    assert got[1, "open"] == ("needs_provider_confirmation", []) and got[3, "open"] == ("needs_provider_confirmation", ["study_mode"]) and got[2, "open"] == ("not_eligible", [])
    assert got[1, "none"] == ("needs_provider_confirmation", [])


def rows(spark):
    data = [("a", "g1", "2026", "not_eligible", "3", "open"), ("b", "g1", "2026", "potential_fit", "9", "open"), ("c", None, "2026", "potential_fit", "5", "open"), ("d", "", "2026", "needs_information", "1", "open"), ("e", "g1", "2025", "potential_fit", "1", "closed"), ("f", "g2", "2026", "potential_fit", None, None)]
    return spark.createDataFrame(data, "id string, gid string, cycle string, status string, deadline string, availability string")


def order():
    return [rules.status_rank(F.col("status")), F.coalesce("deadline", F.lit("~"))]


def test_group_pages(spark):
    whole = evaluate.group_page(rows(spark), "id", "gid", "cycle", "status", order(), "availability", 10, 0)
    assert (whole.total, whole.total_groups, whole.excluded_closed_count) == (5, 4, 1)
    got = [(r.place, r.group_id, r.first, r.members, r.member_status_counts) for r in whole.rows.orderBy("place").collect()]
    assert got == [(1, None, "c", ["c"], {"potential_fit": 1}), (2, "g1", "b", ["b", "a"], {"potential_fit": 1, "not_eligible": 1}), (3, "g2", "f", ["f"], {"potential_fit": 1}), (4, None, "d", ["d"], {"needs_information": 1})]
    second = evaluate.group_page(rows(spark), "id", "gid", "cycle", "status", order(), "availability", 2, 2)
    assert [r.first for r in second.rows.orderBy("place").collect()] == ["f", "d"]
    assert evaluate.group_page(rows(spark), "id", "gid", "cycle", "status", order(), "availability", 2, 9).rows.count() == 0
    closed = evaluate.group_page(rows(spark), "id", "gid", "cycle", "status", order(), "availability", 1, 0, include_closed=True)
    assert closed.total == 6 and closed.excluded_closed_count == 0 and [r.first for r in closed.rows.collect()] == ["e"]


def test_pages_of_matches(spark):
    one = evaluate.page(rows(spark), [*order(), F.col("id")], "availability", 2, 1)
    assert (one.total, one.excluded_closed_count) == (5, 1) and [r.id for r in one.rows.orderBy("place").collect()] == ["b", "f"]
    assert evaluate.page(rows(spark).where("false"), [*order(), F.col("id")], "availability", 2, 0).total == 0


def test_first_mentions_and_first_predicates(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, None), (1, 2, "a"), (1, 3, "b")], "k int, at int, f string")
    assert [r.fields for r in evaluate.first_mentions(df, "k", "f", F.col("at")).collect()] == [["b", "a"]]
    nodes = trees(spark, a={"mandatory": [p("gpa", "gte", 3), p("campus", "eq", "x"), p("campus", "eq", "y")]}).withColumn("cycle", F.lit(1))
    earlier = nodes.withColumn("cycle", F.lit(0)).withColumn("value_arr", F.array(F.lit("early"))).where("field = 'gpa'")
    assert [r.value_arr for r in evaluate.first_predicate(nodes, "campus").collect()] == [["x"]]
    assert [r.value_arr for r in evaluate.first_predicate(nodes.unionByName(earlier), "gpa").collect()] == [["early"]]


def test_explained_matches(spark):
    from quillon.operators import matching

    cond = lambda field, op, value, *ids, **more: {**p(field, op, value), "evidence_ids": list(ids), **more}
    nodes = trees(spark, r={"mandatory": [cond("education_level", "in", ["full_degree", "college"], "e2", "e1"), {"type": "any", "children": [cond("campus", "eq", "North", "e1"), cond("gpa", "gte", 3, "e3", scale="4.0")]}], "unstructured": [{"text": "ask us", "evidence_ids": ["e4"]}]})
    who = spark.createDataFrame([(1, "college", "South", "2.0", "4.0"), (2, "none", None, None, None), (3, "college", "north ", "1", "4.0")], "who int, education_level string, campus string, gpa string, gpa_scale string")
    kinds = {"education_level": "enum", "campus": "soft", "gpa": "decimal"}
    got = {r.who: r for r in matching.explained(nodes, who, "who", kinds, {"gpa": "Average"}, {"campus": "Where?"}, {"college": "College"}, scale="gpa_scale").collect()}
    one = got[1]
    assert one.match_status == "needs_provider_confirmation" and [x.description for x in one.passed_rules] == ["education_level is one of full degree, College"]
    assert [(x.path, x.reason) for x in one.unknown_rules] == [("/mandatory/1/children/0", "mapping_ambiguous"), ("/unstructured/0", "source_unknown")] and one.failed_rules == []
    assert one.source_uncertainties == ["campus: your answer could not be matched to the rule by name; the provider must confirm (campus is North).", "The source leaves this open: ask us"]
    assert one.cited == ["e2", "e1", "e4"] and one.missing_fields == []
    assert got[2].match_status == "not_eligible" and [x.field for x in got[2].failed_rules] == ["education_level"] and got[2].unknown_rules == []
    assert got[3].match_status == "needs_provider_confirmation" and [x.field for x in got[3].passed_rules] == ["education_level", "campus"]
    two = {r.who: r for r in matching.explained(nodes.where("section = 'mandatory'"), who.withColumn("education_level", F.lit("college")), "who", kinds, {}, {"campus": "Where?", "gpa": "What?"}, scale="gpa_scale").collect()}
    assert two[2].missing_fields == ["campus", "gpa"] and two[2].clarification_questions == ["Where?", "What?"] and two[2].match_status == "needs_information"
    plain = {(r.who, r.rule_id): r.match_status for r in matching.matched(nodes, who, "who", kinds, "gpa_scale").collect()}
    assert plain == {(k, "r"): r.match_status for k, r in got.items()}
