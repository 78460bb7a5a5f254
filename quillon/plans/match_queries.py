"""Listing rules made from generated trees, evaluated, and pages of matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, rules
from .tables import query, read

EDUCATION = {"ECONOMY": "college", "PROMO": "graduate"}


def part_rules(spark, sf_dir):
    """A tree of conditions for each part, by its size, brand, name and type: predicates, groups, unknown ones, bad ones, and fields that listings don't have."""
    c = F.col
    say = lambda when, *json: F.when(when, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in json)))
    items = F.array_compact(F.array(
        say(c("p_size") > 25, '{"type":"predicate","field":"education_level","op":"in","value":["', c("p_type"), '","PROMO"]}'),
        say(c("p_brand").endswith("1"), '{"type":"any","children":[{"type":"predicate","field":"residence_province","op":"eq","value":"', c("p_type"), '"},{"type":"unknown"}]}'),
        say(c("p_type") == "SMALL", '{"type":"predicate","field":"residence_province","op":"eq","value":"BC"}'),
        say(c("p_type") == "LARGE", '{"type":"predicate","field":"institution_province","op":"in","value":["BC","ON"]}'),
        say(c("p_name").startswith("cold"), '{"type":"unknown","reason":"', c("p_name"), '"}'),
        say(c("p_size") <= 10, '{"type":"predicate","field":"study_status","op":"in","value":["full_time","', c("p_brand"), '"]}'),
        say(c("p_name").endswith("widget"), '{"type":"predicate","field":"gpa","op":"gte","value":', c("p_size"), "}"),
        say(c("p_name").endswith("gear"), '{"type":"predicate","field":"education_level","op":"gte","value":"x"}'),
        say(c("p_brand").endswith("2"), '{"type":"predicate","field":"indigenous_identity","op":"overlaps","value":["metis","', c("p_brand"), '"]}'),
    ))
    tree = F.concat(F.lit('{"mandatory":['), F.array_join(items, ","), F.lit('],"preferences":[{"type":"predicate","field":"institution_id","op":"eq","value":"u"}],"unstructured":[{"text":"more"}]}'))
    return rules.flatten(read(spark, sf_dir, "part").select("p_partkey", tree.alias("tree")), "p_partkey", "tree")


#: Children in their order: a field (null: unknown), its operator and values.
CHILDREN = """p AS (SELECT p_partkey, list_filter([
        CASE WHEN p_size > 25 THEN {'f': 'education_level', 'o': 'in', 'v': [CASE p_type WHEN 'ECONOMY' THEN 'college' WHEN 'PROMO' THEN 'graduate' ELSE p_type END, 'graduate']} END,
        CASE WHEN p_brand LIKE '%1' THEN {'f': NULL, 'o': NULL, 'v': NULL} END,
        CASE WHEN p_type = 'SMALL' THEN {'f': 'residence_province', 'o': 'eq', 'v': ['British Columbia']} END,
        CASE WHEN p_type = 'LARGE' THEN {'f': 'institution_province', 'o': 'in', 'v': ['BC', 'ON']} END,
        CASE WHEN p_name LIKE 'cold%' THEN {'f': NULL, 'o': NULL, 'v': NULL} END,
        CASE WHEN p_size <= 10 THEN {'f': 'study_mode', 'o': 'in', 'v': ['full_time', p_brand]} END,
        CASE WHEN p_name LIKE '%widget' THEN {'f': NULL, 'o': NULL, 'v': NULL} END,
        CASE WHEN p_name LIKE '%gear' THEN {'f': NULL, 'o': NULL, 'v': NULL} END,
        CASE WHEN p_brand LIKE '%2' THEN {'f': 'communities', 'o': 'overlaps', 'v': ['Métis', p_brand]} END], lambda x: x IS NOT NULL) AS c FROM part),
    l AS (SELECT p_partkey, CASE WHEN len(list_filter(c, lambda x: x.f IS NOT NULL)) > 0 THEN c END AS c FROM p)"""


@query(f"""WITH {CHILDREN} SELECT CAST(p_partkey AS VARCHAR) AS rule_id, CASE WHEN c IS NULL THEN 'unknown' ELSE 'all' END AS kind, array_to_string(list_transform(c, lambda x: coalesce(x.f || ' ' || x.o || ' ' || array_to_string(x.v, ','), 'unknown')), '; ') AS children FROM l""")
def listing_rules(spark, sf_dir):
    made = evaluate.listing_rules(part_rules(spark, sf_dir), EDUCATION)
    text = F.transform("children", lambda x: F.coalesce(F.concat(x.field, F.lit(" "), x.op, F.lit(" "), F.array_join(x["values"], ",")), F.lit("unknown")))
    return made.select("rule_id", "kind", F.array_join(text, "; ").alias("children"))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN [p_type, 'PROMO'] END AS v FROM part) SELECT CAST(p_partkey AS VARCHAR) AS rule_id, 'in' AS op, array_to_string(v, ',') AS value FROM e WHERE v IS NOT NULL""")
def first_predicates(spark, sf_dir):
    nodes = part_rules(spark, sf_dir).withColumn("cycle", F.lit(0))
    # A second cycle that says the same otherwise, which must not be the first.
    later = nodes.withColumns({"cycle": F.lit(1), "value_arr": F.array(F.lit("later"))}).join(nodes.where("field = 'education_level' and kind = 'predicate'").select("rule_id").distinct(), "rule_id", "left_semi")
    return evaluate.first_predicate(nodes.unionByName(later), "education_level").select("rule_id", "op", F.array_join("value_arr", ",").alias("value"))


#: Profiles: one for each region, whose name chooses what it says.
WHO = """w AS (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN ['college'] WHEN r_regionkey = 1 THEN ['graduate'] END AS education_level, CASE WHEN r_regionkey < 3 THEN ['British Columbia'] END AS residence_province,
    CASE WHEN r_regionkey > 0 THEN ['BC'] END AS institution_province, CASE WHEN r_regionkey <> 4 THEN ['full_time'] ELSE ['part_time'] END AS study_mode, CASE WHEN r_regionkey = 2 THEN ['Métis', 'Inuit'] WHEN r_regionkey = 3 THEN [] WHEN r_regionkey = 0 THEN ['Inuit'] END AS communities FROM region)"""


@query(f"""WITH {CHILDREN}, {WHO}, k AS (SELECT r_regionkey, p_partkey, c IS NULL AS open, unnest(CASE WHEN c IS NULL THEN [{{'f': NULL, 'o': NULL, 'v': NULL}}] ELSE c END) AS x,
        map {{'education_level': education_level, 'residence_province': residence_province, 'institution_province': institution_province, 'study_mode': study_mode, 'communities': communities}} AS said FROM l, w),
    t AS (SELECT r_regionkey, p_partkey, x.f AS f, CASE WHEN x.f IS NULL THEN 1 WHEN said[x.f] IS NULL OR len(said[x.f]) = 0 THEN 1 WHEN list_has_any(x.v, said[x.f]) THEN 2 ELSE 0 END AS t FROM k),
    g AS (SELECT r_regionkey, p_partkey, min(t) AS t, bool_or(f IS NULL) AS open, string_agg(DISTINCT CASE WHEN t = 1 THEN f END, ',' ORDER BY CASE WHEN t = 1 THEN f END) AS missing FROM t GROUP BY ALL)
    SELECT r_regionkey, CAST(p_partkey AS VARCHAR) AS rule_id, CASE t WHEN 2 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'unknown' END AS result, CASE WHEN t = 2 THEN 'potential_fit' WHEN t = 0 THEN 'not_eligible' WHEN open THEN 'needs_provider_confirmation' ELSE 'needs_information' END AS match_status,
    CASE WHEN t = 1 THEN coalesce(missing, '') ELSE '' END AS missing, t = 1 AND open AS source_unknown, CASE WHEN t = 1 AND open THEN 'Confirm current requirements with the provider' ELSE 'Review the evidence and application route' END AS next_action FROM g""")
def evaluate_listing(spark, sf_dir):
    r, k = read(spark, sf_dir, "region"), F.col("r_regionkey")
    who = r.select(k, F.when(k % 2 == 0, "college").when(k == 1, "graduate").alias("education_level"), F.when(k < 3, "British Columbia").alias("residence_province"), F.when(k > 0, "BC").alias("institution_province"),
                   F.when(k != 4, "full_time").otherwise("part_time").alias("study_mode"), F.when(k == 2, F.array(F.lit("Métis"), F.lit("Inuit"))).when(k == 3, F.array().cast("array<string>")).when(k == 0, F.array(F.lit("Inuit"))).alias("communities"))
    made = evaluate.evaluated(evaluate.listing_rules(part_rules(spark, sf_dir), EDUCATION), who, "r_regionkey", ["education_level", "residence_province", "institution_province", "study_mode", "communities"])
    return made.withColumn("missing", F.array_join("missing", ","))


#: Orders as matches: a status by priority, an application shared by a customer's orders of one year (urgent ones stand alone), closed ones by status and price.
MATCHES = """m AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'g' || o_custkey END AS gid, strftime(o_orderdate, '%Y') AS cycle, strftime(o_orderdate, '%Y-%m-%d') AS deadline,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'potential_fit' WHEN '3-MEDIUM' THEN 'needs_information' WHEN '5-LOW' THEN 'not_eligible' ELSE 'needs_provider_confirmation' END AS status,
    CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 3 ELSE 2 END AS k, o_orderstatus = 'F' AND o_totalprice < 100000 AS closed FROM orders)"""
SIZE = 20


def matches(spark, sf_dir):
    o, pr = read(spark, sf_dir, "orders"), F.col("o_orderpriority")
    status = F.when(pr == "2-HIGH", "potential_fit").when(pr == "3-MEDIUM", "needs_information").when(pr == "5-LOW", "not_eligible").otherwise("needs_provider_confirmation")
    return o.select(F.col("o_orderkey").alias("id"), F.when(pr != "1-URGENT", F.concat(F.lit("g"), "o_custkey")).alias("gid"), F.date_format("o_orderdate", "yyyy").alias("cycle"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"), status.alias("status"),
                    F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000), "closed").otherwise("open").alias("availability"))


@query(f"""WITH {MATCHES}, x AS (SELECT *, row_number() OVER (ORDER BY k, deadline, id) AS r FROM m WHERE NOT closed), n AS (SELECT count(*) FILTER (WHERE NOT closed) AS total, count(*) FILTER (WHERE closed) AS excluded FROM m),
    g AS (SELECT coalesce(gid, '') AS gid, CASE WHEN gid IS NULL THEN id END AS single, cycle, min(r) AS first, min_by(id, r) AS first_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS members,
        concat_ws(',', CASE WHEN count(*) FILTER (k = 2) > 0 THEN 'needs_provider_confirmation=' || count(*) FILTER (k = 2) END, CASE WHEN count(*) FILTER (k = 1) > 0 THEN 'needs_information=' || count(*) FILTER (k = 1) END,
            CASE WHEN count(*) FILTER (k = 3) > 0 THEN 'not_eligible=' || count(*) FILTER (k = 3) END, CASE WHEN count(*) FILTER (k = 0) > 0 THEN 'potential_fit=' || count(*) FILTER (k = 0) END) AS counts FROM x GROUP BY ALL),
    q AS (SELECT *, row_number() OVER (ORDER BY first) AS place, count(*) OVER () AS total_groups FROM g)
    SELECT CAST(place AS INTEGER) AS place, nullif(gid, '') AS group_id, cycle AS cycle_key, first_id AS "first", members, list_aggregate(list_sort(string_split(counts, ',')), 'string_agg', ',') AS counts, total, total_groups, excluded
    FROM q, n WHERE place <= {2 * SIZE} OR place > total_groups - {SIZE}""")
def match_group_pages(spark, sf_dir):
    m = matches(spark, sf_dir)
    order = [rules.status_rank(F.col("status")), F.col("deadline")]
    at = lambda offset: evaluate.group_page(m, "id", "gid", "cycle", "status", order, "availability", SIZE, offset)
    one, two = at(0), at(SIZE)
    last = at(max(one.total_groups - SIZE, 2 * SIZE))  # the last page, which does not begin before the third
    rows = one.rows.unionByName(two.rows).unionByName(last.rows)
    counts = F.array_join(F.array_sort(F.transform(F.map_entries("member_status_counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))), ",")
    return rows.select("place", "group_id", "cycle_key", "first", F.array_join("members", ",").alias("members"), counts.alias("counts"), F.lit(one.total).cast("long").alias("total"), F.lit(one.total_groups).cast("long").alias("total_groups"), F.lit(one.excluded_closed_count).cast("long").alias("excluded"))


@query("""WITH p AS (SELECT l_orderkey, l_returnflag || l_linestatus AS f, min((l_linenumber, l_partkey, l_suppkey)) AS a FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(f, ',' ORDER BY a, f) AS fields FROM p GROUP BY l_orderkey""")
def fields_by_first_mention(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("field", F.concat("l_returnflag", "l_linestatus"))
    made = evaluate.first_mentions(l, "l_orderkey", "field", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return made.select("l_orderkey", F.array_join("fields", ",").alias("fields"))
