"""Records in two versions merged, and evidence attached to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports
from .tables import query, read


def version(spark, sf_dir, states, name, fetched):
    """A record for each customer: a cycle for each year of its orders in some states, evidence for each order, a reference for each priority."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin(*states)).withColumn("year", F.date_format("o_orderdate", "yyyy"))
    cycles = o.groupBy("o_custkey", "year").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("year").alias("cycle_key"), "n", F.lit(name).alias("version")))).alias("cycles"))
    item = F.struct(F.concat(F.lit("e"), "o_orderkey").alias("id"), F.concat(F.lit("/cycles/"), "year", F.when(F.col("o_orderpriority") == "5-LOW", "/amount").otherwise("")).alias("field_path"), F.lit(name).alias("version"))
    item = F.struct(F.col("o_orderkey"), item.alias("e"))
    ref = F.struct(F.col("o_orderpriority").alias("snapshot_id"), F.lit(name).alias("version"))
    rest = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.e).alias("evidence"), F.array_sort(F.collect_set(ref)).alias("source_refs"), F.lit(fetched).alias("last_fetched_at"))
    return cycles.join(rest, "o_custkey").withColumn("title", F.lit(name)).withColumnRenamed("o_custkey", "id")


@query("""WITH o AS (SELECT *, strftime(o_orderdate, '%Y') AS year, 'e' || o_orderkey AS e FROM orders), s AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
    a AS (SELECT * FROM o WHERE o_orderstatus IN ('F', 'P')), b AS (SELECT * FROM o WHERE o_orderstatus IN ('O', 'P') AND o_custkey NOT IN (SELECT c_custkey FROM s)),
    i AS (SELECT DISTINCT o_custkey AS id FROM a UNION SELECT DISTINCT o_custkey FROM b),
    y AS (SELECT o_custkey AS id, year, bool_or(v = 1) AS old, bool_or(v = 2) AS new, count(*) FILTER (WHERE v = 1) AS n1, count(*) FILTER (WHERE v = 2) AS n2 FROM (SELECT *, 1 AS v FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY ALL),
    cy AS (SELECT id, string_agg(year || ':' || CASE WHEN new THEN n2 || ':new' ELSE n1 || ':old' END, ',' ORDER BY NOT old, year) AS cycles FROM y GROUP BY id),
    ev AS (SELECT o_custkey AS id, o_orderkey, e, 1 AS side FROM b UNION ALL SELECT a.o_custkey, a.o_orderkey, a.e, 2 FROM a LEFT JOIN y ON y.id = a.o_custkey AND y.year = a.year WHERE NOT y.new AND a.e NOT IN (SELECT e FROM b)),
    ee AS (SELECT id, string_agg(e || CASE side WHEN 1 THEN ':new' ELSE ':old' END, ',' ORDER BY side, o_orderkey) AS evidence FROM ev GROUP BY id),
    r AS (SELECT o_custkey AS id, o_orderpriority AS p, bool_or(v = 1) AS old, bool_or(v = 2) AS new FROM (SELECT *, 1 AS v FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY ALL),
    rr AS (SELECT id, string_agg(p || CASE WHEN new THEN ':new' ELSE ':old' END, ',' ORDER BY NOT old, p) AS refs FROM r GROUP BY id),
    k AS (SELECT id, EXISTS (SELECT 1 FROM a WHERE o_custkey = id) AS old, EXISTS (SELECT 1 FROM b WHERE o_custkey = id) AS new FROM i)
    SELECT id, CASE WHEN new THEN 'new' ELSE 'old' END AS title, CASE WHEN NOT old THEN 'created' WHEN new THEN 'merged' ELSE 'retained' END AS action, cycles, coalesce(evidence, '') AS evidence, refs, CASE WHEN new THEN '2026-10-02' ELSE '2026-10-01' END AS last_fetched_at
    FROM k JOIN cy USING (id) LEFT JOIN ee USING (id) JOIN rr USING (id)""")
def import_merge(spark, sf_dir):
    old, new = version(spark, sf_dir, ("F", "P"), "old", "2026-10-01"), version(spark, sf_dir, ("O", "P"), "new", "2026-10-02")
    gone = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    m = imports.merged_records(old, new, superseded=gone)
    say = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return m.select("id", "title", "action", say("cycles", lambda c: F.concat_ws(":", c.cycle_key, c.n, c.version)), say("evidence", lambda e: F.concat_ws(":", e.id, e.version)), F.array_join(F.transform("source_refs", lambda r: F.concat_ws(":", r.snapshot_id, r.version)), ",").alias("refs"), "last_fetched_at")


def marked_documents(spark, sf_dir):
    """A document for each order: its lines as cycles, whose deadlines, windows and application cite quotes by markers."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    c = F.col
    marker = lambda quote, snapshot=None: F.concat(F.lit('{"quote":"'), quote, F.lit('"'), *([] if snapshot is None else [F.lit(',"snapshot":"'), snapshot, F.lit('"')]), F.lit("}"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    cycle = lambda x, i: F.concat(F.lit('{"cycle_key":"'), i.cast("string"), F.lit("/"), x.l_partkey.cast("string"), F.lit('","starts_on":'), F.when(x.l_returnflag == "R", F.concat(F.lit('"'), x.day, F.lit('"'))).otherwise("null"), F.lit(',"window_evidence_ids":['), marker(F.concat(F.lit("window "), x.day)), F.lit('],"deadlines":[{"evidence_ids":["kept",'), marker(F.concat(F.lit("due "), x.day), F.concat(F.lit("s"), (x.l_suppkey).cast("string"))), F.lit("]}]}"))
    lines = l.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), cycle), ",").alias("cycles"))
    made = F.concat(F.lit('{"application":{"application_group_id":"g","group_evidence_ids":['), marker(c("o_orderpriority")), F.lit(']},"cycles":['), "cycles", F.lit("]}"))
    return o.join(lines, "o_orderkey").select("o_orderkey", F.concat(F.lit("order"), "o_custkey").alias("own"), made.alias("document"))


MARKED = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, strftime(l_shipdate, '%Y-%m-%d')) - 1 AS i, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    m AS (SELECT l_orderkey AS o_orderkey, '/cycles/' || i || '~1' || l_partkey AS c, day, l_returnflag, o_custkey, l_suppkey FROM l),
    e AS (SELECT o_orderkey, c || CASE WHEN l_returnflag = 'R' THEN '/starts_on' ELSE '/ends_on' END AS field_path, 'snap_order' || o_custkey AS snapshot_id, 'window ' || day AS quote FROM m
        UNION ALL SELECT o_orderkey, c || '/deadlines/0', 'snap_s' || l_suppkey, 'due ' || day FROM m JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0
        UNION ALL SELECT o_orderkey, '/application/application_group_id', 'snap_order' || o_custkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM m)),
    h AS (SELECT *, left(sha256(field_path || chr(31) || snapshot_id || chr(31) || quote), 16) AS id FROM e)"""


def cited(spark, sf_dir):
    """The documents, the snapshots that they may cite, and the columns' names."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    names = c.select(F.concat(F.lit("order"), "c_custkey").alias("snapshot")).union(s.select(F.concat(F.lit("s"), "s_suppkey")))
    return marked_documents(spark, sf_dir), names.withColumn("snapshot_id", F.concat(F.lit("snap_"), "snapshot")), "o_orderkey", "document", "own"


@query(f"WITH {MARKED} SELECT o_orderkey, id, field_path, snapshot_id, quote FROM h")
def evidence_attach(spark, sf_dir):
    return imports.attached_evidence(*cited(spark, sf_dir))


@query(f"""WITH {MARKED}, n AS (SELECT m.o_orderkey, count(*) FILTER (WHERE s_acctbal < 0) AS nulls FROM m JOIN supplier ON s_suppkey = l_suppkey GROUP BY m.o_orderkey),
    t AS (SELECT o_orderkey, string_agg(id, ',' ORDER BY id) AS ids FROM h GROUP BY o_orderkey)
    SELECT o_orderkey, ids, nulls, 0 AS markers FROM t JOIN n USING (o_orderkey)""")
def attached_documents(spark, sf_dir):
    d = imports.attached_documents(*cited(spark, sf_dir))
    ids = F.sort_array(F.regexp_extract_all("document", F.lit(r'"([0-9a-f]{16})"'), 1))
    return d.select("o_orderkey", F.array_join(ids, ",").alias("ids"), F.regexp_count("document", F.lit('"kept",null')).cast("long").alias("nulls"), F.regexp_count("document", F.lit('"quote"')).alias("markers"))
