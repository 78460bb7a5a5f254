"""Records by id, names of institutions, replay of stored pages, states of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import lookups
from ..sources.tables import institutions
from .tables import query, read


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND o_totalprice > 200000 AND c_mktsegment <> 'MACHINERY'")
def record_lookups(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, "published").otherwise("draft").alias("publication_status"), (F.col("c_mktsegment") == "MACHINERY").alias("is_demo"))
    asked = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.many(lookups.scan(c, demo=False), asked, "c_custkey").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT lower(n_name) AS alias, n_nationkey AS id FROM nation UNION ALL SELECT 'region ' || n_regionkey, n_nationkey FROM nation), u AS (SELECT alias, min(id) AS id FROM a GROUP BY alias HAVING count(DISTINCT id) = 1)
    SELECT c_custkey, CAST(CASE WHEN c_acctbal > 5000 THEN c_nationkey ELSE u.id END AS INTEGER) AS institution_id FROM customer JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN u ON u.alias = CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'region ' || n_regionkey WHEN c_mktsegment = 'BUILDING' THEN 'nowhere' ELSE lower(n_name) END""")
def institution_by_name(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    names = institutions(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Region  "), "n_regionkey")).alias("aliases")))
    segment = F.col("c_mktsegment")
    said = F.when(F.col("c_acctbal") < 0, None).when(segment == "MACHINERY", F.concat(F.lit("REGION "), "n_regionkey")).when(segment == "BUILDING", "nowhere").otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit("\t")))
    who = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey")).cast("int").alias("institution_id"), said.alias("institution_name"))
    return lookups.with_institution(who, names).select("c_custkey", "institution_id")


@query(r"""WITH c AS (SELECT page_id, regexp_extract(url, '://[^/]*\.(example\.[a-z]+)', 1) AS source_id, length(html) < 8000 AS ok, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^&]*|gclid=[^&]*)(&|$)', '\1'), '[?&]$', '') || '#' || page_id AS u FROM pages),
    d AS (SELECT *, length(u) - length(replace(u, '/', '')) AS depth FROM c WHERE ok)
    SELECT page_id, source_id, source_id || ':' || (row_number() OVER (PARTITION BY source_id ORDER BY depth, u) - 1) AS key FROM d""")
def replay_order(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    u = F.concat(urls.canonical(F.col("url")), F.lit("#"), "page_id")
    entries = p.select("page_id", F.regexp_extract("url", r"://[^/]*\.(example\.[a-z]+)", 1).alias("source_id"), F.when(F.length("html") < 8000, "ok").otherwise("failed").alias("status"), u.alias("final_url"), (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))).alias("depth"))
    return lookups.replayed(entries).select("page_id", "source_id", "key")


@query("""WITH e AS (SELECT l_suppkey AS s, l_returnflag AS f FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.07), n AS (SELECT l_suppkey AS s, count(*) AS attempted, count(*) FILTER (WHERE l_returnflag = 'N') AS succeeded, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag = 'A') AS blocked FROM lineitem WHERE l_quantity = 1 AND l_discount > 0.08 GROUP BY 1)
    SELECT s_suppkey AS source_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.s = s_suppkey AND f = 'N') THEN 'ok' WHEN coalesce(failed, 0) + coalesce(blocked, 0) > 0 THEN 'failed' ELSE 'no_data' END AS status, CASE WHEN s_acctbal < 0 THEN 'restricted' ELSE 'open' END AS access_status,
    coalesce(attempted, 0) AS attempted, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(blocked, 0) AS blocked, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS not_modified FROM supplier LEFT JOIN n ON n.s = s_suppkey""")
def source_states(spark, sf_dir):
    l, s = read(spark, sf_dir, "lineitem").withColumn("source_id", F.col("l_suppkey")), read(spark, sf_dir, "supplier")
    entries = l.where("l_quantity = 50 and l_discount > 0.07").select("source_id", F.when(F.col("l_returnflag") == "N", "ok").otherwise("failed").alias("status"))
    is_ = lambda flag: (F.col("l_returnflag") == flag).cast("long")
    stats = l.where("l_quantity = 1 and l_discount > 0.08").select("source_id", F.lit(1).alias("attempted"), is_("N").alias("succeeded"), is_("R").alias("failed"), is_("A").alias("blocked"), F.lit(0).alias("skipped"), F.lit(0).alias("not_modified"))
    sources = s.select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_acctbal") < 0, "restricted").otherwise("open").alias("access_status"))
    return lookups.source_states(sources, entries, stats, F.lit(False))
