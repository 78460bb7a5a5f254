"""Search, scopes, facets and statistics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import publishing, search, statistics
from .tables import query, read

PARTS = search.Columns(id="p_partkey", text=("p_name", "p_brand", "p_type"), title="p_name", provider="p_brand", community=None, type="p_type", goals=None, province="p_none", amount="p_retailprice", amount_kind=None, renewable=None, deadline_kind=None, order="p_size", lists=())


@query("SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM part WHERE p_brand IN ('Brand#6', 'Brand#17', 'Brand#23') AND p_retailprice > 950 ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def search_multi_filter(spark, sf_dir):
    f = search.Filters(providers=("Brand#6", "Brand#17", "Brand#23"), amount_band="high", amount_limit=950, sort="amount")
    return search.search(read(spark, sf_dir, "part"), f, PARTS, limit=100).select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")


CUSTOMERS = """WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS seg FROM customer)
    SELECT c_custkey, coalesce(seg IN ('BUILDING', 'MACHINERY'), true) AS kept_with_unknown, coalesce(seg IN ('BUILDING', 'MACHINERY'), false) AS kept_strictly FROM c"""


@query(CUSTOMERS)
def search_unknown_policy(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.array_compact(F.array(F.nullif("c_mktsegment", F.lit("FURNITURE")))).alias("seg"))
    wanted = ("BUILDING", "MACHINERY")
    return c.select("c_custkey", search.keeps(F.col("seg"), wanted, True).alias("kept_with_unknown"), search.keeps(F.col("seg"), wanted, False).alias("kept_strictly"))


@query("SELECT doc_id, contains(strip_accents(lower(text)), 'de la') AS phrase FROM documents")
def search_phrase_folded(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.contains_phrase(F.col("text"), " DÉ lá ").alias("phrase"))


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'elle') AND contains(strip_accents(lower(text)), 'reau')")
def search_all_terms_folded(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.contains_terms(F.col("text"), "Réau  ELLE")).select("doc_id")


PLACED = """SELECT s.s_suppkey, s.s_acctbal, s.s_name, CASE r.r_name WHEN 'AFRICA' THEN NULL WHEN 'ASIA' THEN 'all' ELSE r.r_name END AS province
    FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


def placed(spark, sf_dir):
    """Suppliers with a province: one region stands for nationwide, one for not stated."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    province = F.when(F.col("r_name") == "ASIA", "all").when(F.col("r_name") != "AFRICA", F.col("r_name"))
    return joined.select("s_suppkey", "s_acctbal", "s_name", province.alias("province"))


@query(f"WITH p AS ({PLACED}) SELECT CASE WHEN coalesce(province, '') = '' THEN 'unspecified' WHEN province = 'all' THEN 'national' ELSE 'regional' END AS scope, count(*) AS n FROM p GROUP BY 1")
def scope_buckets(spark, sf_dir):
    return placed(spark, sf_dir).groupBy(statistics.scope(F.col("province")).alias("scope")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({PLACED}) SELECT r.r_name AS name, count(p.s_suppkey) AS regional_count, (SELECT count(*) FROM p WHERE province = 'all') AS national_count,
    count(p.s_suppkey) + (SELECT count(*) FROM p WHERE province = 'all') AS reach_count FROM region r LEFT JOIN p ON p.province = r.r_name GROUP BY r.r_name""")
def region_statistics(spark, sf_dir):
    return statistics.by_region(placed(spark, sf_dir), "province", read(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query(f"""WITH p AS ({PLACED}) SELECT count(*) AS total, count(*) FILTER (province = 'all') AS national_count, count(*) FILTER (province IS NOT NULL AND province <> 'all') AS regional_count,
    count(*) FILTER (province IS NULL) AS unspecified_count, count(nullif(s_acctbal < 0, true)) AS amount_listed, count(*) FILTER (s_acctbal < 0) AS amount_unknown,
    max(s_acctbal) AS amount_highest, count(*) FILTER (s_acctbal >= 0 AND s_acctbal <= 5000) AS up_to_limit, count(*) FILTER (s_acctbal > 5000) AS above_limit FROM p""")
def statistics_overview(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("amount", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")))
    return statistics.overview(p, "province", "amount")


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS value FROM part), c AS (SELECT value, count(*) AS n FROM w GROUP BY value)
    SELECT v.value, coalesce(c.n, 0) AS n FROM (VALUES ('STEEL'), ('BRASS'), ('SMALL'), ('NOTHING')) v(value) LEFT JOIN c USING (value)""")
def multi_value_counts(spark, sf_dir):
    return statistics.by_value(read(spark, sf_dir, "part"), F.split("p_type", " "), ("STEEL", "BRASS", "SMALL", "NOTHING"))


@query("SELECT CASE WHEN o_totalprice IS NULL THEN 'unknown' WHEN o_totalprice <= 5000 THEN 'up_to_5000' ELSE 'above_5000' END AS band, count(*) AS n FROM (SELECT nullif(o_totalprice, round(o_totalprice)) AS o_totalprice FROM orders) GROUP BY 1")
def amount_bands(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.nullif("o_totalprice", F.round("o_totalprice")).alias("x"))
    return o.groupBy(money.band(F.col("x")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_orderstatus = 'F') AS done, max(o_totalprice) AS highest, min(o_totalprice) AS lowest, count(DISTINCT o_custkey) AS customers FROM orders")
def amount_summary(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max("o_totalprice").alias("highest"), F.min("o_totalprice").alias("lowest"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT 'o_orderpriority' AS facet, o_orderpriority AS value FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders GROUP BY ALL")
def facet_distinct(spark, sf_dir):
    return search.facets(read(spark, sf_dir, "orders"), ("o_orderpriority", "o_orderstatus"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping(o_orderpriority, o_orderstatus) AS INTEGER) AS grouped FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def facet_cube(spark, sf_dir):
    return statistics.facet_cube(read(spark, sf_dir, "orders"), ("o_orderpriority", "o_orderstatus"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_listing(spark, sf_dir):
    page = search.listing(read(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40)
    return page.select("o_orderkey", "o_orderpriority", "o_totalprice", "total")


@query("SELECT round(o_totalprice, -3) AS x, sum(count(*)) OVER (ORDER BY round(o_totalprice, -3)) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1".replace("/ (", "* 1.0 / (").replace("sum(count(*)) OVER (ORDER BY round(o_totalprice, -3))", "round(sum(count(*)) OVER (ORDER BY round(o_totalprice, -3))").replace("FROM orders) AS share", "FROM orders), 6) AS share"))
def ecdf(spark, sf_dir):
    values = read(spark, sf_dir, "orders").select(F.round("o_totalprice", -3).alias("x"))
    return statistics.ecdf(values, "x").select("x", F.round("share", 6).alias("share"))


@query("SELECT round(quantile_cont(o_totalprice, 0.25), 2) AS q25, round(quantile_cont(o_totalprice, 0.5), 2) AS q50, round(quantile_cont(o_totalprice, 0.75), 2) AS q75 FROM orders")
def median_quantiles(spark, sf_dir):
    q = statistics.quantiles(read(spark, sf_dir, "orders"), "o_totalprice", (0.25, 0.5, 0.75))
    return q.select(*(F.round(c, 2).alias(c) for c in q.columns))


@query("""WITH v AS (SELECT ln(1 + o_totalprice) AS v FROM orders), s AS (SELECT count(*) AS n, stddev_samp(v) AS sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iqr, min(v) AS lo, max(v) AS hi FROM v),
    h AS (SELECT n, lo, hi, greatest(0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * n ^ (-0.2), 0.05) AS h FROM s), g AS (SELECT k, lo + (hi - lo) * k / 31.0 AS p, n, h FROM h, range(32) r(k))
    SELECT CAST(k AS INTEGER) AS k, round(any_value(p), 4) AS at, round(sum(exp(-((p - v) / h) ^ 2 / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density FROM g, v GROUP BY k""".replace("exp(-((p - v) / h) ^ 2 / 2)", "exp(-1 * pow((p - v) / h, 2) / 2)"))
def kde_log_amount(spark, sf_dir):
    return statistics.density(read(spark, sf_dir, "orders"), "o_totalprice").select("k", F.round("at", 4).alias("at"), F.round("density", 4).alias("density"))


WHERE = """SELECT c.c_custkey, c.c_mktsegment, CASE r.r_name WHEN 'ASIA' THEN 'all' ELSE r.r_name END AS province FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
NAMES, SEGMENTS = ("AFRICA", "AMERICA", "EUROPE", "NOWHERE"), ("BUILDING", "MACHINERY", "FURNITURE")


def customers(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("c_custkey", "c_mktsegment", F.when(F.col("r_name") == "ASIA", "all").otherwise(F.col("r_name")).alias("province"))


@query(f"""WITH c AS ({WHERE}) SELECT a.name, b.grp AS "group", count(c.c_custkey) AS n FROM (VALUES ('AFRICA'), ('AMERICA'), ('EUROPE'), ('NOWHERE')) a(name) CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('FURNITURE')) b(grp)
    LEFT JOIN c ON c.c_mktsegment = b.grp AND (c.province = a.name OR c.province = 'all') GROUP BY 1, 2""")
def coverage_matrix(spark, sf_dir):
    return statistics.coverage(customers(spark, sf_dir), "province", F.array("c_mktsegment"), NAMES, SEGMENTS)


@query("""WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k FROM c)
    SELECT CASE WHEN k <= 11 THEN name ELSE 'Other' END AS name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_n_other(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return statistics.top_and_rest(counts, "name", "n")


@query("""WITH c AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1), s AS (SELECT name, floor(n * 100.0 / sum(n) OVER ()) AS base, n * 100.0 / sum(n) OVER () - floor(n * 100.0 / sum(n) OVER ()) AS over FROM c),
    r AS (SELECT *, row_number() OVER (ORDER BY round(over, 9) DESC, name) AS k, 100 - sum(base) OVER () AS room FROM s) SELECT name, CAST(base + CASE WHEN k <= room THEN 1 ELSE 0 END AS BIGINT) AS tiles FROM r""")
def waffle_largest_remainder(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return statistics.waffle(counts, "name", "n")


@query(f"""WITH c AS ({WHERE}), o AS (SELECT c.province, o.o_totalprice, o.o_orderpriority, year(o.o_orderdate) AS y FROM orders o JOIN c ON o.o_custkey = c.c_custkey)
    SELECT CASE WHEN province IN ('AFRICA', 'AMERICA', 'EUROPE') THEN province END AS province, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS verified, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
    CAST(min(y) AS INTEGER) AS oldest, CAST(max(y) AS INTEGER) AS newest, count(DISTINCT o_orderpriority) AS providers FROM o GROUP BY 1""")
def region_summary(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return statistics.region_summary(o, "province", "o_totalprice", "o_orderpriority", F.year("o_orderdate"), F.col("o_totalprice") > 100000, ("AFRICA", "AMERICA", "EUROPE"))


@query("""WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), d AS (SELECT n, ntile(5) OVER (ORDER BY n) AS class FROM (SELECT DISTINCT n FROM c)) SELECT c.name, c.n, CAST(d.class AS INTEGER) AS class FROM c JOIN d USING (n)""")
def colour_classes(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return statistics.classes(counts, "n").select("name", "n", "class")


@query("""SELECT p_partkey, p_name AS title, CASE WHEN regexp_matches(p_type, '(?i)\\bsteel\\b') THEN 'postsecondary,training' ELSE 'postsecondary' END AS goals,
    'Apply by ' || strftime(DATE '2026-01-01' + INTERVAL (p_size) DAY, '%b %-d, %Y') AS timing, CASE WHEN p_size < 10 THEN 'Region not stated' WHEN p_size < 20 THEN 'Across Canada' ELSE p_brand END AS location,
    CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS amount FROM part""".replace("(?i)\\bsteel\\b", r"(?i)\bsteel\b"))
def publish_transform(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    province = F.when(F.col("p_size") < 10, None).when(F.col("p_size") < 20, "all").otherwise(F.col("p_brand"))
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")).cast("string")
    none = F.lit(None).cast("string")
    deadlines = F.array(F.struct(F.lit("date").alias("kind"), day.alias("date"), none.alias("raw_text")))
    kind = F.when(F.col("p_size") % 2 == 0, "fixed").otherwise("variable")
    figure = publishing.amount(kind, F.col("p_retailprice").cast("string"), none, none)
    return p.select("p_partkey", F.col("p_name").alias("title"), F.array_join(publishing.goals(F.regexp_replace("p_type", r"(?i)\bsteel\b", "trades")), ",").alias("goals"), publishing.timing(deadlines).alias("timing"), publishing.location(province).alias("location"), figure.amount.alias("amount"))


@query("SELECT n_nationkey, 10 * (row_number() OVER (ORDER BY n_regionkey, n_name) - 1) AS display_order FROM nation")
def display_order(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return publishing.display_order(n, "n_nationkey", F.col("n_regionkey"), F.col("n_name")).select("n_nationkey", F.col("display_order").cast("long").alias("display_order"))
