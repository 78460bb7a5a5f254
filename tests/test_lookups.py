"""Look-ups by id and name, and what became of sources."""

from pyspark.sql import functions as F

from quillon.operators import lookups


def test_records_by_id(spark):
    r = spark.createDataFrame([("a", "published", False), ("b", "draft", False), ("c", "published", True)], "id string, publication_status string, is_demo boolean")
    assert [x.id for x in lookups.one(r, "id", "a").collect()] == ["a"] and lookups.one(r, "id", "b").count() == 0 and lookups.one(r, "id", "b", published_only=False).count() == 1
    asked = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("z",)], "id string")
    assert sorted(x.id for x in lookups.many(r, asked, "id").collect()) == ["a", "c"]
    assert sorted(x.id for x in lookups.scan(r, published_only=False, demo=False).collect()) == ["a", "b"]


def test_names_stand_for_ids_only_where_none_is_given(spark):
    who = spark.createDataFrame([(1, None, " North  College "), (2, "other", "north college"), (3, None, "other"), (4, None, None)], "k int, institution_id string, institution_name string")
    names = spark.createDataFrame([("north college", "nc")], "alias string, id string")
    assert {r.k: r.institution_id for r in lookups.with_institution(who, names).collect()} == {1: "nc", 2: "other", 3: None, 4: None}


def test_regions_of_institutions(spark):
    conditions = spark.createDataFrame([("r1", ["u1"]), ("r2", ["u1", "u2"]), ("r3", ["u9"]), ("r4", ["u2"]), ("r5", ["u3"])], "rule_id string, value_arr array<string>")
    places = spark.createDataFrame([("u1", "BC"), ("u2", None), ("u3", "XX")], "id string, province string")
    assert {(r.rule_id, r.region, r.basis) for r in lookups.institution_region(conditions, places).collect()} == {("r1", "British Columbia", "rule"), ("r5", "XX", "rule")}


def test_sources_and_replay(spark):
    entries = spark.createDataFrame([("s1", "ok", 1, "b"), ("s1", "ok", 1, "a"), ("s1", "ok", 0, "z"), ("s1", "failed", 0, "y"), ("s2", "ok", None, "q"), ("s3", "failed", 0, "w")], "source_id string, status string, depth int, final_url string")
    assert {r.key: r.final_url for r in lookups.replayed(entries).collect()} == {"s1:0": "z", "s1:1": "a", "s1:2": "b", "s2:0": "q"}
    sources = spark.createDataFrame([(s, "open") for s in ("s1", "s2", "s3", "s4")], "source_id string, access_status string")
    stats = spark.createDataFrame([("s3", 2, 0, 2, 0, 0, 0), ("s3", 1, 0, 0, 1, 0, 0)], "source_id string, attempted int, succeeded int, failed int, blocked int, skipped int, not_modified int")
    states = lookups.source_states(sources, entries, stats, F.lit(False))
    assert {r.source_id: (r.status, r.attempted, r.failed) for r in states.collect()} == {"s1": ("ok", 0, 0), "s2": ("ok", 0, 0), "s3": ("failed", 3, 2), "s4": ("no_data", 0, 0)}
    assert tuple(lookups.run_summary(states, 1).first()) == (4, 2, 2, 1)
    assert lookups.replayed(entries.where("false")).count() == 0
