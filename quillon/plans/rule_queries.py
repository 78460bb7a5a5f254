"""Rules, matching, cycles and deadlines on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import availability, freshness, matching, rules
from ..sources.tables import institutions
from .tables import query, read

p = lambda field, op, value: {"type": "predicate", "field": field, "op": op, "value": value}
RULES = {
    "building": {"mandatory": [p("segment", "in", ["BUILDING", "MACHINERY"])]},
    "either": {"mandatory": [{"type": "any", "children": [p("region", "eq", "EUROPE"), p("level", "gte", 5000)]}]},
    "nested": {"mandatory": [{"type": "all", "children": [p("segment", "in", ["BUILDING", "HOUSEHOLD"]), {"type": "any", "children": [p("region", "eq", "ASIA"), p("level", "gte", 1000)]}]}, p("region", "in", ["ASIA", "EUROPE", "AMERICA"])]},
    "open": {"mandatory": [p("segment", "eq", "AUTOMOBILE")], "unstructured": [{"text": "as the provider decides"}]},
}
KINDS = {"segment": "enum", "region": "code", "level": "int"}

# Profiles: a segment and a balance that some customers don't state.
PROFILES = """p AS (SELECT c.c_custkey, nullif(c.c_mktsegment, 'FURNITURE') AS segment, r.r_name AS region, CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS level
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
TRUTH = f"""WITH {PROFILES}, t AS (SELECT c_custkey,
    CASE WHEN segment IS NULL THEN 1 WHEN segment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 0 END AS s1, CASE WHEN region = 'EUROPE' THEN 2 ELSE 0 END AS r1,
    CASE WHEN level IS NULL THEN 1 WHEN level >= 5000 THEN 2 ELSE 0 END AS l1, CASE WHEN segment IS NULL THEN 1 WHEN segment IN ('BUILDING', 'HOUSEHOLD') THEN 2 ELSE 0 END AS s2,
    CASE WHEN region = 'ASIA' THEN 2 ELSE 0 END AS r2, CASE WHEN level IS NULL THEN 1 WHEN level >= 1000 THEN 2 ELSE 0 END AS l2,
    CASE WHEN region IN ('ASIA', 'EUROPE', 'AMERICA') THEN 2 ELSE 0 END AS r3, CASE WHEN segment IS NULL THEN 1 WHEN segment = 'AUTOMOBILE' THEN 2 ELSE 0 END AS s3 FROM p),
    w AS (SELECT c_custkey, 'building' AS rule_id, s1 AS truth FROM t UNION ALL SELECT c_custkey, 'either', greatest(r1, l1) FROM t
    UNION ALL SELECT c_custkey, 'nested', least(s2, greatest(r2, l2), r3) FROM t UNION ALL SELECT c_custkey, 'open', least(s3, 1) FROM t)"""


def profiles(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment"), F.col("r_name").alias("region"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("level"))


def nodes(spark):
    """The rule table above as nodes. Its fields are the carrier's own, so the flattener's field check is left out."""
    rows = []

    def add(rule, section, node, parent, depth, path, counter):
        number = counter[0]
        counter[0] += 1
        value = node.get("value")
        rows.append((rule, section, number, parent, depth, node["type"], node.get("field"), node.get("op"), None if value is None else [str(v) for v in (value if isinstance(value, list) else [value])], None, node.get("reason"), path, [], None))
        for i, child in enumerate(node.get("children", [])):
            add(rule, section, child, number, depth + 1, f"{path}/children/{i}", counter)

    for rule, tree in RULES.items():
        counter = [0]
        for section, items in (("mandatory", tree.get("mandatory", [])), ("unstructured", [{"type": "unknown", "reason": u["text"]} for u in tree.get("unstructured", [])])):
            for i, node in enumerate(items):
                add(rule, section, node, None, 0, f"/{section}/{i}", counter)
    return spark.createDataFrame(rows, rules.NODES)


@query(f"{TRUTH} SELECT c_custkey, rule_id, CAST(truth AS INTEGER) AS truth FROM w")
def kleene_nested_fold(spark, sf_dir):
    who, tree = profiles(spark, sf_dir), nodes(spark)
    leaves = matching.leaf_truths(tree, who, "c_custkey", KINDS)
    folded = rules.fold(tree, leaves.select("c_custkey", "rule_id", "node_id", "truth"), "c_custkey")
    return rules.outcome(folded, "c_custkey", tree.select("rule_id").distinct(), tree.where("section = 'unstructured'").select("rule_id"))


@query(f"""{TRUTH}, x AS (SELECT w.*, segment, level, s2, r2, l2, r1, l1 FROM w JOIN t USING (c_custkey) JOIN p USING (c_custkey))
    SELECT c_custkey, rule_id, CAST(truth AS INTEGER) AS truth,
    CASE truth WHEN 0 THEN 'not_eligible' WHEN 2 THEN 'potential_fit' ELSE CASE WHEN rule_id = 'open' THEN 'needs_provider_confirmation' ELSE 'needs_information' END END AS match_status,
    CASE WHEN truth <> 1 THEN '' ELSE concat_ws(',', CASE WHEN level IS NULL AND ((rule_id = 'either') OR (rule_id = 'nested' AND greatest(r2, l2) = 1)) THEN 'level' END,
        CASE WHEN segment IS NULL AND rule_id IN ('building', 'nested', 'open') THEN 'segment' END) END AS missing_fields,
    CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN truth = 2 THEN 0 WHEN truth = 0 THEN 3 WHEN rule_id = 'open' THEN 2 ELSE 1 END, rule_id) AS INTEGER) AS place FROM x""")
def match_status_rank(spark, sf_dir):
    found = matching.matched(nodes(spark), profiles(spark, sf_dir), "c_custkey", KINDS)
    order = matching.ordering(F.col("match_status"), F.lit(None).cast("string"), F.col("rule_id"), F.lit(""))
    return found.select("c_custkey", "rule_id", "truth", "match_status", F.concat_ws(",", "missing_fields").alias("missing_fields"), F.row_number().over(Window.partitionBy("c_custkey").orderBy(*order)).alias("place"))


@query(f"""{TRUTH}, l AS (SELECT c_custkey, 'building' AS rule_id, 0 AS leaf, s1 AS x, s1 AS up FROM t UNION ALL SELECT c_custkey, 'either', 1, r1, greatest(r1, l1) FROM t UNION ALL SELECT c_custkey, 'either', 2, l1, greatest(r1, l1) FROM t
    UNION ALL SELECT c_custkey, 'nested', 1, s2, least(s2, greatest(r2, l2)) FROM t
    UNION ALL SELECT c_custkey, 'nested', 3, r2, CASE WHEN r2 = greatest(r2, l2) AND r2 = least(s2, greatest(r2, l2)) THEN r2 ELSE -1 END FROM t
    UNION ALL SELECT c_custkey, 'nested', 4, l2, CASE WHEN l2 = greatest(r2, l2) AND l2 = least(s2, greatest(r2, l2)) THEN l2 ELSE -1 END FROM t
    UNION ALL SELECT c_custkey, 'nested', 5, r3, r3 FROM t UNION ALL SELECT c_custkey, 'open', 0, s3, s3 FROM t UNION ALL SELECT c_custkey, 'open', 1, 1, 1 FROM t)
    SELECT l.c_custkey, l.rule_id, CAST(l.leaf AS INTEGER) AS leaf, CAST(l.x AS INTEGER) AS truth FROM l JOIN w USING (c_custkey, rule_id)
    WHERE l.x = l.up AND ((w.truth = 0 AND l.x = 0) OR (w.truth = 2 AND l.x = 2) OR (w.truth = 1 AND l.x > 0))""")
def rule_blame_lists(spark, sf_dir):
    who, tree = profiles(spark, sf_dir), nodes(spark)
    leaves = matching.leaf_truths(tree, who, "c_custkey", KINDS).select("c_custkey", "rule_id", "node_id", "truth")
    folded = rules.fold(tree, leaves, "c_custkey")
    outcomes = rules.outcome(folded, "c_custkey", tree.select("rule_id").distinct(), tree.where("section = 'unstructured'").select("rule_id"))
    return rules.blamed(folded, rules.ancestors(tree, 3), outcomes, "c_custkey")


LABELS, PRETTY = {"segment": "Segment", "region": "Region", "level": "Balance"}, {"BUILDING": "buildings"}
QUESTIONS = {"segment": "Which segment?", "level": "Which balance?"}
BLAMED = f"""{TRUTH}, d(rule_id, leaf, f, says) AS (VALUES ('building', 0, 'segment', 'Segment is one of buildings, MACHINERY'), ('either', 1, 'region', 'Region is EUROPE'), ('either', 2, 'level', 'Balance is at least 5000'), ('nested', 1, 'segment', 'Segment is one of buildings, HOUSEHOLD'),
        ('nested', 3, 'region', 'Region is ASIA'), ('nested', 4, 'level', 'Balance is at least 1000'), ('nested', 5, 'region', 'Region is one of ASIA, EUROPE, AMERICA'), ('open', 0, 'segment', 'Segment is AUTOMOBILE'), ('open', 1, NULL, 'as the provider decides')),
    l AS (SELECT c_custkey, 'building' AS rule_id, 0 AS leaf, s1 AS x, true AS same FROM t UNION ALL SELECT c_custkey, 'either', 1, r1, r1 = greatest(r1, l1) FROM t UNION ALL SELECT c_custkey, 'either', 2, l1, l1 = greatest(r1, l1) FROM t
        UNION ALL SELECT c_custkey, 'nested', 1, s2, s2 = least(s2, greatest(r2, l2)) FROM t UNION ALL SELECT c_custkey, 'nested', 3, r2, r2 = greatest(r2, l2) AND r2 = least(s2, greatest(r2, l2)) FROM t
        UNION ALL SELECT c_custkey, 'nested', 4, l2, l2 = greatest(r2, l2) AND l2 = least(s2, greatest(r2, l2)) FROM t UNION ALL SELECT c_custkey, 'nested', 5, r3, true FROM t UNION ALL SELECT c_custkey, 'open', 0, s3, true FROM t UNION ALL SELECT c_custkey, 'open', 1, 1, true FROM t),
    y AS (SELECT l.c_custkey, l.rule_id, w.truth, l.leaf, l.x, d.f, d.says FROM l JOIN w USING (c_custkey, rule_id) JOIN d USING (rule_id, leaf) WHERE same AND CASE WHEN w.truth = 1 THEN l.x > 0 ELSE l.x = w.truth END)"""


@query(f"""{BLAMED}, z AS (SELECT w.c_custkey, w.rule_id, w.truth, CASE w.truth WHEN 0 THEN 'not_eligible' WHEN 2 THEN 'potential_fit' ELSE CASE WHEN w.rule_id = 'open' THEN 'needs_provider_confirmation' ELSE 'needs_information' END END AS match_status,
        coalesce(string_agg(says, '; ' ORDER BY leaf) FILTER (WHERE x = 2), '') AS passed, coalesce(string_agg(says, '; ' ORDER BY leaf) FILTER (WHERE x = 0), '') AS failed, coalesce(string_agg(says, '; ' ORDER BY leaf) FILTER (WHERE x = 1), '') AS unknown,
        coalesce(string_agg(f, ',' ORDER BY leaf) FILTER (WHERE x = 1 AND f IS NOT NULL), '') AS missing_fields, coalesce(string_agg('Which ' || CASE f WHEN 'level' THEN 'balance' ELSE f END || '?', ',' ORDER BY leaf) FILTER (WHERE x = 1 AND f IS NOT NULL), '') AS questions,
        coalesce(string_agg('The source leaves this open: ' || says, ',') FILTER (WHERE x = 1 AND f IS NULL), '') AS uncertainties FROM w LEFT JOIN y USING (c_custkey, rule_id) GROUP BY ALL)
    SELECT c_custkey, rule_id, match_status, passed, failed, unknown, missing_fields, questions, uncertainties, CASE match_status
        WHEN 'not_eligible' THEN 'You do not appear to meet the recorded conditions. Check the failed rules and the official page in case your situation is an exception: https://o.example.org/' || rule_id
        WHEN 'needs_information' THEN 'Answer the clarification questions so the remaining conditions can be checked.'
        WHEN 'needs_provider_confirmation' THEN 'Some conditions can only be confirmed by the provider or administrator. Contact them via ' || CASE WHEN rule_id = 'open' THEN 'https://c.example.org/' ELSE 'https://o.example.org/' || rule_id END || '.'
        ELSE CASE region WHEN 'ASIA' THEN 'You appear to meet the recorded conditions and the application window looks open. Review the official page and apply: ' || CASE rule_id WHEN 'building' THEN 'https://a.example.org/' ELSE 'https://o.example.org/' || rule_id END
            WHEN 'EUROPE' THEN 'You appear to meet the recorded conditions, but applications have not opened yet. Check https://o.example.org/' || rule_id || ' for the opening date.'
            WHEN 'AMERICA' THEN 'You appear to meet the recorded conditions, but this cycle has closed. Check https://o.example.org/' || rule_id || ' for the next intake.'
            WHEN 'AFRICA' THEN 'You appear to meet the recorded conditions. The deadline is set locally; contact the administrator: ' || CASE rule_id WHEN 'building' THEN 'https://a.example.org/' ELSE 'https://o.example.org/' || rule_id END
            ELSE 'You appear to meet the recorded conditions. Confirm the current application window on the official page: https://o.example.org/' || rule_id END END AS next_action FROM z JOIN p USING (c_custkey)""")
def match_explained(spark, sf_dir):
    who = profiles(spark, sf_dir)
    found = matching.explained(nodes(spark), who, "c_custkey", KINDS, LABELS, QUESTIONS, PRETTY).join(who.select("c_custkey", "region"), "c_custkey")
    region, rule = F.col("region"), F.col("rule_id")
    window = F.when(region == "ASIA", "open").when(region == "EUROPE", "upcoming").when(region == "AMERICA", "closed").when(region == "AFRICA", "contact_administrator").otherwise("unknown")
    action = matching.next_action(F.col("match_status"), window, F.concat(F.lit("https://o.example.org/"), rule), F.when(rule == "building", "https://a.example.org/"), F.when(rule == "open", "https://c.example.org/").otherwise(""))
    words = lambda c, name: F.array_join(F.transform(c, lambda x: x.description), "; ").alias(name)
    return found.select("c_custkey", "rule_id", "match_status", words("passed_rules", "passed"), words("failed_rules", "failed"), words("unknown_rules", "unknown"), F.array_join("missing_fields", ",").alias("missing_fields"),
                        F.array_join("clarification_questions", ",").alias("questions"), F.array_join("source_uncertainties", ",").alias("uncertainties"), action.alias("next_action"))


@query(f"""WITH {PROFILES} SELECT c_custkey, CAST(CASE WHEN segment IS NULL THEN 1 WHEN segment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 0 END AS INTEGER) AS in_segment,
    CAST(CASE WHEN level IS NULL THEN 1 WHEN level >= 5000 THEN 2 ELSE 0 END AS INTEGER) AS rich, CAST(CASE WHEN segment = 'BUILDING' THEN 2 ELSE 1 END AS INTEGER) AS named FROM p""")
def kleene_rule_eval(spark, sf_dir):
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    want = lambda *v: F.array(*map(F.lit, v))
    return profiles(spark, sf_dir).select("c_custkey", rules.leaf_truth(F.lit("enum"), F.lit("in"), one("segment"), want("building", "Machinery ")).alias("in_segment"), rules.leaf_truth(F.lit("int"), F.lit("gte"), one("level"), want("5000")).alias("rich"), rules.leaf_truth(F.lit("soft"), F.lit("eq"), one("segment"), want("Building")).alias("named"))


@query(f"""WITH {PROFILES}, x AS (SELECT c_custkey, CASE WHEN segment IS NULL THEN 1 WHEN segment = 'BUILDING' THEN 2 ELSE 0 END AS a, CASE WHEN region = 'ASIA' THEN 2 ELSE 0 END AS b FROM p)
    SELECT c_custkey, CASE WHEN greatest(a, b) = 2 THEN 'applies' WHEN greatest(a, b) = 0 THEN 'not_applicable' ELSE 'unknown' END AS applicability FROM x""")
def applicability_filter(spark, sf_dir):
    who = profiles(spark, sf_dir)
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    truths = F.array(rules.leaf_truth(F.lit("enum"), F.lit("eq"), one("segment"), F.array(F.lit("building"))), rules.leaf_truth(F.lit("code"), F.lit("eq"), one("region"), F.array(F.lit("asia"))))
    return rules.applicability(who.select("c_custkey", F.explode(truths).alias("truth")), "c_custkey")


@query(f"{TRUTH} SELECT rule_id, count(*) FILTER (truth = 2) AS fits, count(*) FILTER (truth = 1) AS unknown, count(*) FILTER (truth = 0) AS fails FROM w GROUP BY rule_id")
def match_counts(spark, sf_dir):
    m = kleene_nested_fold(spark, sf_dir)
    return m.groupBy("rule_id").agg(F.count_if(F.col("truth") == 2).alias("fits"), F.count_if(F.col("truth") == 1).alias("unknown"), F.count_if(F.col("truth") == 0).alias("fails"))


@query("""WITH a AS (SELECT n_nationkey AS id, lower(n_name) AS alias FROM nation UNION ALL SELECT n_nationkey, lower(left(n_name, 2)) FROM nation), u AS (SELECT alias, min(id) AS id FROM (SELECT DISTINCT alias, id FROM a) GROUP BY alias HAVING count(DISTINCT id) = 1)
    SELECT c.c_custkey, CAST(u.id AS INTEGER) AS id FROM (SELECT c_custkey, lower(left(n_name, 2)) AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey) c LEFT JOIN u USING (alias)""")
def alias_resolve_unique(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    names = institutions(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.left("n_name", F.lit(2))).alias("aliases")))
    asked = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.lower(F.left("n_name", F.lit(2))).alias("alias"))
    return asked.join(F.broadcast(names), "alias", "left").select("c_custkey", "id")  # names: two for each nation


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 3 ELSE 4 END AS k FROM orders)
    SELECT o_custkey, o_orderkey FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k, d DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1""".replace("CAST(o_orderkey AS VARCHAR) DESC", "rpad(CAST(o_orderkey AS VARCHAR), 20, 'z') DESC"))
def select_best_cycle(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "unknown").otherwise("closed"))
    place = availability.best_first("o_custkey", availability.rank(F.col("status")), F.unix_date(F.to_date("o_orderdate")), F.col("o_orderkey").cast("string"))
    return o.withColumn("place", place).where("place = 1").select("o_custkey", "o_orderkey")


AS_OF = "1995-06-17T12:00:00Z"


def cycles(spark, sf_dir):
    """Orders as cycles: a start, an end 90 days on for some, and a deadline of a kind by the priority."""
    day = F.to_date("o_orderdate")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "rolling").when(F.col("o_orderpriority").startswith("2"), "local_administrator").when(F.col("o_orderpriority").startswith("3"), "unspecified").otherwise("date")
    date = F.when(kind == "date", F.date_add(day, 30).cast("string"))
    deadlines = F.array(F.struct(kind.alias("kind"), date.alias("date"), none.alias("local_time"), none.alias("timezone")))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day.cast("string").alias("starts_on"), F.when(F.col("o_orderkey") % 2 == 0, F.date_add(day, 90).cast("string")).alias("ends_on"), deadlines.alias("deadlines"), kind.alias("kind"))


AVAILABLE = f"""WITH c AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 90 END AS e, CAST(o_orderdate AS DATE) + 30 AS d,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'rolling' WHEN '2' THEN 'local_administrator' WHEN '3' THEN 'unspecified' ELSE 'date' END AS kind, TIMESTAMP '{AS_OF[:19].replace("T", " ")}' AS t FROM orders),
    x AS (SELECT *, t >= CAST(s AS TIMESTAMP) - INTERVAL 14 HOUR AS started, coalesce(t >= CAST(e AS TIMESTAMP) + INTERVAL 36 HOUR, false) AS ended, kind = 'date' AND t < CAST(d AS TIMESTAMP) + INTERVAL 36 HOUR AS pending FROM c),
    a AS (SELECT *, CASE WHEN NOT started THEN 'upcoming' WHEN ended THEN 'closed' WHEN kind = 'date' AND NOT pending THEN 'closed' WHEN pending AND started THEN 'open' WHEN kind = 'rolling' THEN 'open'
    WHEN kind = 'local_administrator' THEN 'contact_administrator' WHEN started AND e IS NOT NULL THEN 'open' ELSE 'unknown' END AS status FROM x)"""


@query(f"{AVAILABLE} SELECT o_orderkey, status, CASE WHEN pending THEN strftime(CAST(d AS TIMESTAMP) + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS next_deadline FROM a")
def availability_status(spark, sf_dir):
    seen = cycles(spark, sf_dir).withColumn("a", availability.availability(F.col("starts_on"), F.col("ends_on"), F.col("deadlines"), F.lit(dates.as_of_seconds(AS_OF))))
    return seen.select("o_orderkey", "a.status", dates.utc_text(F.timestamp_seconds("a.next_deadline")).alias("next_deadline"))


@query(f"""{AVAILABLE} SELECT o_custkey, o_orderkey, status FROM a
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'contact_administrator' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END,
    greatest(s, coalesce(e, s), CASE WHEN kind = 'date' THEN d ELSE s END) DESC, rpad(CAST(o_orderkey AS VARCHAR), 20, 'z') DESC) = 1""")
def current_cycles(spark, sf_dir):
    c = cycles(spark, sf_dir).withColumn("cycle_key", F.col("o_orderkey").cast("string"))
    return availability.select_cycle(c, F.lit(dates.as_of_seconds(AS_OF)), "o_custkey").select("o_custkey", "o_orderkey", "availability.status")


@query(f"""{AVAILABLE} SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'closed') AS expired, count(*) FILTER (kind = 'rolling') AS rolling, count(*) FILTER (kind = 'unspecified') AS deadline_unknown,
    count(*) FILTER (o_orderkey % 7 = 0) AS never_verified, count(*) FILTER (o_orderkey % 7 <> 0 AND epoch(t) - epoch(CAST(s AS TIMESTAMP)) > 30 * 86400) AS verification_stale, count(DISTINCT o_custkey) AS distinct_administrators,
    greatest(0, 20000 - count(*)) AS shortfall FROM a""")
def freshness_counters(spark, sf_dir):
    at = F.lit(dates.as_of_seconds(AS_OF))
    c = cycles(spark, sf_dir).withColumn("availability", availability.availability(F.col("starts_on"), F.col("ends_on"), F.col("deadlines"), at))
    lit = F.lit
    selected = c.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("provider_id"), lit("award").alias("opportunity_type"), lit("published").alias("publication_status"), lit("machine_checked").alias("review_status"), F.when(F.col("o_orderkey") % 7 != 0, dates.seconds_of(F.col("starts_on").cast("date"))).alias("verified_at"), lit("c").alias("cycle_key"), "availability", F.array("kind").alias("kinds"), lit("fixed").alias("amount_kind"), lit(1).alias("mandatory"), lit(0).alias("unstructured"), lit(1).alias("documents"), lit(0).alias("conflicts"), lit(None).cast("string").alias("group_id"), lit(False).alias("is_demo"))
    return freshness.report(selected, at, 30, 20000).select("total", "open", "expired", "rolling", "deadline_unknown", "never_verified", "verification_stale", "distinct_administrators", "shortfall")


@query("""WITH e AS (SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, TIMESTAMP '2024-01-16 12:00:00' AS t FROM events)
    SELECT event_id, strftime(d + INTERVAL 10 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS earliest, strftime(d + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS latest,
    CASE WHEN t >= d + INTERVAL 36 HOUR THEN 'closed' WHEN t < d + INTERVAL 10 HOUR THEN 'not_closed' ELSE 'closing_ambiguous' END AS state FROM e""")
def close_window_unknown_tz(spark, sf_dir):
    none = F.lit(None).cast("string")
    e = read(spark, sf_dir, "events").select("event_id", dates.close_window(F.lit("date"), F.to_date("ts").cast("string"), none, none).alias("w"))
    return e.select("event_id", dates.utc_text(F.timestamp_seconds("w.earliest")).alias("earliest"), dates.utc_text(F.timestamp_seconds("w.latest")).alias("latest"), dates.state(F.col("w"), F.lit(dates.as_of_seconds("2024-01-16T12:00:00Z"))).alias("state"))


def zoned_deadlines(spark, sf_dir):
    """A deadline for each order, 31 years on: its zone by the priority, its time by the price; those of pending orders fall in the small hours of a day on which clocks change."""
    c = F.col
    price, day = F.floor("o_totalprice"), F.add_months(F.to_date("o_orderdate"), 12 * 31)
    first = lambda month: F.make_date(F.year(day), F.lit(month), F.lit(1))
    sunday = lambda d: F.date_add(d, (8 - F.dayofweek(d)) % 7)
    change = F.when(F.month(day) <= 6, F.date_add(sunday(first(3)), 7)).otherwise(sunday(first(11)))
    pending = c("o_orderstatus") == "P"
    hour = F.when(pending, price % 4).otherwise(F.floor(price / 60) % 24)
    time = F.when(c("o_orderstatus") != "F", F.format_string("%02d:%02d", hour, price % 60))
    zone = F.when(c("o_orderpriority") == "1-URGENT", "America/Toronto").when(c("o_orderpriority") == "2-HIGH", "America/Halifax").when(c("o_orderpriority") == "3-MEDIUM", "America/Regina").when(c("o_orderpriority") == "5-LOW", "Eastern Time")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(pending, change).otherwise(day).cast("string").alias("date"), time.alias("local_time"), zone.alias("zone"))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(floor(o_totalprice) AS BIGINT) AS x, CAST(CAST(o_orderdate AS DATE) + INTERVAL 31 YEAR AS DATE) AS d FROM orders),
    b AS (SELECT *, make_date(year(d), 3, 1) AS mar, make_date(year(d), 11, 1) AS nov FROM a),
    c AS (SELECT *, CAST(mar + CAST((7 - dayofweek(mar)) % 7 + 7 AS INTEGER) AS DATE) AS spring, CAST(nov + CAST((7 - dayofweek(nov)) % 7 AS INTEGER) AS DATE) AS autumn FROM b),
    e AS (SELECT *, CASE WHEN s = 'P' THEN CASE WHEN month(d) <= 6 THEN spring ELSE autumn END ELSE d END AS day, CASE WHEN s = 'P' THEN x % 4 WHEN s <> 'F' THEN (x // 60) % 24 END AS h,
        CASE p WHEN '1-URGENT' THEN 5 WHEN '5-LOW' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 6 END AS std FROM c),
    f AS (SELECT *, CASE WHEN s = 'F' THEN CAST(day AS TIMESTAMP) + INTERVAL 1 DAY ELSE CAST(day AS TIMESTAMP) + to_hours(h) + to_minutes(x % 60) END AS l, CASE WHEN s = 'F' THEN INTERVAL 0 MINUTE ELSE INTERVAL 1 MINUTE END AS past FROM e),
    g AS (SELECT *, CASE WHEN std IS NULL THEN 'unknown' WHEN std = 6 THEN 'std' WHEN l >= CAST(spring AS TIMESTAMP) + INTERVAL 2 HOUR AND l < CAST(spring AS TIMESTAMP) + INTERVAL 3 HOUR THEN 'skipped'
        WHEN l >= CAST(autumn AS TIMESTAMP) + INTERVAL 1 HOUR AND l < CAST(autumn AS TIMESTAMP) + INTERVAL 2 HOUR THEN 'repeated' WHEN l >= CAST(spring AS TIMESTAMP) + INTERVAL 3 HOUR AND l < CAST(autumn AS TIMESTAMP) + INTERVAL 1 HOUR THEN 'dst' ELSE 'std' END AS k FROM f),
    w AS (SELECT *, l + past + CASE k WHEN 'unknown' THEN -INTERVAL 14 HOUR WHEN 'std' THEN to_hours(std) ELSE to_hours(std - 1) END AS lo, l + past + CASE k WHEN 'unknown' THEN INTERVAL 12 HOUR WHEN 'dst' THEN to_hours(std - 1) ELSE to_hours(std) END AS hi FROM g)
    SELECT o_orderkey, strftime(lo, '%Y-%m-%dT%H:%M:%SZ') AS earliest, strftime(hi, '%Y-%m-%dT%H:%M:%SZ') AS latest, CASE k WHEN 'unknown' THEN 'timezone_unknown' WHEN 'skipped' THEN 'dst_skipped_local_time' WHEN 'repeated' THEN 'dst_repeated_local_time' ELSE '' END AS flags,
    CASE WHEN s = 'F' THEN 'end_of_local_day' ELSE 'stated_time' END AS basis FROM w""")
def close_window_tz(spark, sf_dir):
    d = zoned_deadlines(spark, sf_dir).withColumn("w", dates.close_window(F.lit("datetime"), F.col("date"), F.col("local_time"), F.col("zone")))
    return d.select("o_orderkey", dates.utc_text(F.timestamp_seconds("w.earliest")).alias("earliest"), dates.utc_text(F.timestamp_seconds("w.latest")).alias("latest"), F.array_join("w.flags", ",").alias("flags"), "w.basis")


@query("""WITH o AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
    SELECT o_orderkey, CAST((SELECT min(x) FROM (SELECT try_cast(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS x FROM range(2026, 2035) r(y)) WHERE x >= DATE '2026-06-15') AS VARCHAR) AS next_on FROM o""")
def next_annual_occurrence(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.next_annual(F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.lit("2026-06-15").cast("date")).cast("string").alias("next_on"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, min((l_linenumber, l_suppkey, l_extendedprice)) AS pos FROM lineitem GROUP BY 1, 2) SELECT l.l_orderkey, string_agg(p.p_brand, ',' ORDER BY l.pos, l.l_partkey) AS refs FROM l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1""")
def evidence_refs_ordered(spark, sf_dir):
    # Every line of an order cites its part, some of them twice; an id that is no part is cited first.
    l, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    order = F.struct("l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey")
    cites = l.groupBy("l_orderkey").agg(F.concat(F.array(F.lit(-1).cast("bigint")), F.transform(F.array_sort(F.collect_list(order)), lambda x: x.l_partkey)).alias("ids"))
    evidence = l.select("l_orderkey", F.col("l_partkey").alias("id")).distinct().join(part, F.col("id") == F.col("p_partkey")).select("l_orderkey", "id", "p_brand")
    found = matching.cited(cites, evidence, "l_orderkey", F.col("ids"))
    return found.select("l_orderkey", F.array_join(F.transform("refs", lambda x: x.p_brand), ",").alias("refs"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS m FROM orders) SELECT a.o_orderkey, count(b.o_orderkey) AS n, coalesce(string_agg(CAST(b.o_orderkey AS VARCHAR), ',' ORDER BY b.o_orderkey), '') AS siblings
    FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND a.m = b.m AND a.o_orderkey <> b.o_orderkey GROUP BY 1""")
def shared_group_siblings(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    s = matching.siblings(o, "o_orderkey", "o_custkey", "m")
    return s.select("o_orderkey", F.size("siblings").cast("long").alias("n"), F.array_join(F.transform("siblings", lambda x: x.cast("string")), ",").alias("siblings"))


@query("""SELECT o_custkey AS group_id, o_orderpriority AS cycle_key, count(*) AS n, min(o_orderkey) AS first, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1, 2""")
def grouped_applications(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    g = matching.grouped(o, "o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", F.col("o_orderkey"))
    return g.select("group_id", "cycle_key", F.size("members").cast("long").alias("n"), "first", F.coalesce(F.try_element_at("counts", F.lit("F")), F.lit(0)).cast("long").alias("done"))


