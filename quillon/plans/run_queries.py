"""Streams of pages into a store, and runs that count what they write."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import documents, merge, runs
from ..sources import tables as files
from ..sources.tables import folder
from ..streaming import store
from .data_queries import SLICES, slices
from .tables import query, read

TRACKED = "url LIKE '%utm_source%'"


def _page_rows(df):
    canonical = urls.canonical(F.col("url"))
    return df.select(canonical.alias("url"), "page_id", (F.length(canonical) - F.length(F.replace(canonical, F.lit("/"), F.lit("")))).alias("depth"), "html")


def _extract(df):
    facts = documents.page_facts(F.col("html"))
    return df.select("*", facts[0], facts[1])


@query(rf"""WITH c AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^&]*|gclid=[^&]*)(&|$)', '\1'), '[?&]$', '') AS url, {TRACKED} AS tracked FROM pages),
    a AS (SELECT url, max(page_id) AS page_id, max_by(html, page_id) AS html FROM c GROUP BY url),
    b AS (SELECT url, max(page_id) AS page_id, max_by(html, page_id) || '<a href="/more">more</a>' AS html FROM c WHERE tracked GROUP BY url),
    s AS (SELECT a.url, coalesce(b.page_id, a.page_id) AS page_id, coalesce(b.html, a.html) AS html, CASE WHEN b.url IS NULL THEN 1 ELSE 2 END AS version FROM a LEFT JOIN b USING (url)),
    d AS (SELECT *, length(url) - length(replace(url, '/', '')) AS depth FROM s)
    SELECT url, page_id, CAST(depth AS INTEGER) AS depth, sha256(html) AS raw_sha256, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
    CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS INTEGER) AS n_links, CAST(version AS INTEGER) AS version, CAST(row_number() OVER (ORDER BY depth, url) - 1 AS BIGINT) AS ordinal FROM d""")
def incremental_extraction(spark, sf_dir):
    """All pages come as files of a stream, then those of tracked addresses with a link more together with the others as they were, then the first files' batch runs again: pages that did not change keep their version."""
    from ..operators.publishing import display_order

    base = folder(spark)
    kept = store.Store(spark, f"{base}/store", store.EXTRACTED, "url", 16)
    step = store.extraction(kept, _extract, "blocks 1")
    pages = read(spark, sf_dir, "pages")
    changed = pages.withColumn("html", F.when(F.expr(TRACKED), F.concat("html", F.lit('<a href="/more">more</a>'))).otherwise(F.col("html")))
    # Of the pages of one address only the changed ones come again with the last word.
    again = changed.where(TRACKED)
    for coming in (pages, again):
        _page_rows(coming).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("url string, page_id long, depth int, html string").parquet(f"{base}/in")
        store.start(stream, step, f"{base}/checkpoint").awaitTermination()
    step(_page_rows(pages), 0)  # was committed: changes nothing
    step(_page_rows(again), 2)  # comes anew, with the same bytes: nothing is extracted
    state = kept.read()
    placed = display_order(state, "url", F.col("depth"), F.col("url"))
    return placed.select("url", "page_id", "depth", "raw_sha256", "title", "n_links", "version", F.floor(F.col("display_order") / 10).alias("ordinal"))


@query(f"""WITH {SLICES}, m AS (SELECT CASE WHEN n.o_orderkey IS NULL THEN 'retained' WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderstatus = o.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
    SELECT 'merge' AS step, 'rows' AS name, count(*) AS n, true AS intact FROM m UNION ALL SELECT 'merge', action, count(*), true FROM m GROUP BY action
    UNION ALL SELECT 'customers', 'rows', count(DISTINCT o_custkey), true FROM orders""")
def run_manifest(spark, sf_dir):
    base = folder(spark)
    old, new = slices(spark, sf_dir)
    now = merge.merged(old, new, ["o_orderkey"], ["o_orderstatus"])
    steps = [("merge", f"{base}/merge", runs.written(now, f"{base}/merge", {a: F.col("action") == a for a in ("created", "updated", "unchanged", "retained")}))]
    steps.append(("customers", f"{base}/customers", runs.written(old.select("o_custkey").distinct(), f"{base}/customers")))
    made = runs.verified(runs.manifest(spark, "run-1", steps))
    return made.select("step", F.explode("counts").alias("name", "n"), "intact")


def event_runs(spark, sf_dir):
    """A run for each user: begun with what was seen, later finished, with numbers of purchases and errors that replace or join its summary."""
    e = read(spark, sf_dir, "events").withColumns({"run_id": F.concat(F.lit("run-"), F.col("user_id")), "ts": F.col("ts").cast("timestamp_ntz")})
    never = F.lit(None).cast("timestamp_ntz")
    old = e.where("event_type <> 'purchase'").groupBy("run_id").agg(F.min("ts").alias("started_at"), F.map_from_arrays(F.array_sort(F.collect_set("event_type")), F.transform(F.array_sort(F.collect_set("event_type")), lambda _: F.lit("seen"))).alias("summary"))
    new = e.where("event_type IN ('purchase', 'error')").groupBy("run_id", "event_type").agg(F.max("ts").alias("ts"), F.count("*").cast("string").alias("n"))
    new = new.groupBy("run_id").agg(F.max("ts").alias("finished_at"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("summary"))
    return runs.merged(old.withColumn("finished_at", never), new.withColumn("started_at", never))


@query("""WITH e AS (SELECT 'run-' || user_id AS run_id, ts, event_type FROM events),
    t AS (SELECT run_id, event_type, CASE WHEN event_type IN ('purchase', 'error') THEN CAST(count(*) AS VARCHAR) ELSE 'seen' END AS v FROM e GROUP BY run_id, event_type),
    r AS (SELECT run_id, min(ts) FILTER (WHERE event_type <> 'purchase') AS started, max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS finished FROM e GROUP BY run_id)
    SELECT run_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(finished, '%Y-%m-%d %H:%M:%S') AS finished_at, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS summary FROM r JOIN t USING (run_id) GROUP BY ALL""")
def run_summaries(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("summary")), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return event_runs(spark, sf_dir).select("run_id", at("started_at"), at("finished_at"), text.alias("summary"))


@query("""WITH r AS (SELECT 'run-' || user_id AS run_id, max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS finished, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id),
    t AS (SELECT * FROM r ORDER BY finished DESC NULLS LAST, run_id DESC LIMIT 25) SELECT run_id, CAST(errors AS VARCHAR) AS errors FROM t WHERE errors > 1 ORDER BY finished DESC NULLS LAST, run_id DESC LIMIT 1""")
def latest_run(spark, sf_dir):
    return runs.latest(event_runs(spark, sf_dir), F.try_element_at("summary", F.lit("error")).try_cast("int") > 1).select("run_id", F.try_element_at("summary", F.lit("error")).alias("errors"))


@query("""SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'json.duplicate_key' WHEN o_totalprice > 200000 THEN 'json.invalid' END AS issue, true AS in_order FROM orders""")
def json_lines(spark, sf_dir):
    """Orders written as JSON lines in files, pending ones with a key twice, dear ones cut short; read back with their line numbers."""
    at = folder(spark)
    o = read(spark, sf_dir, "orders")
    line = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderpriority"))
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('{"o_custkey":0,'), F.substring(line, 2, 10**6))).when(F.col("o_totalprice") > 200000, F.rtrim(F.substring(line, F.lit(1), F.length(line) - 1))).otherwise(line)
    o.select("o_orderkey", line.alias("value")).repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(at)
    back = files.parsed_lines(files.numbered_lines(spark, at), "o_orderkey long, o_custkey long, o_orderpriority string")
    own = F.regexp_extract("line", r'"o_orderkey":(\d+)', 1).cast("long")
    seen = back.withColumn("o_orderkey", own).withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey")))
    return seen.join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey").select("o_orderkey", F.coalesce("record.o_custkey", "o_custkey").alias("o_custkey"), F.coalesce("record.o_orderpriority", "o_orderpriority").alias("o_orderpriority"), "issue", (F.col("_n") == F.col("line_no")).alias("in_order"))
