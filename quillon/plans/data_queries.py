"""Documents, pages, merges, findings, ids and streams on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, hashing, money, text, urls
from ..operators import documents, merge, validation
from ..streaming import events as streams
from .tables import query, read


@query("""WITH b AS (SELECT lower(text) AS t, item_id, 'src' || CAST(item_id % 10 AS VARCHAR) AS p FROM benchmark), d AS (SELECT doc_id, lower(text) AS t, source FROM documents)
    SELECT DISTINCT d.doc_id FROM d LEFT JOIN b ON b.item_id = d.doc_id LEFT JOIN b c ON c.t = d.t AND (contains(d.source, c.p) OR contains(c.p, d.source)) WHERE b.item_id IS NOT NULL OR c.item_id IS NOT NULL""")
def supersession_anti_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("title"), F.col("source").alias("provider"))
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("title"), F.concat(F.lit("src"), F.col("item_id") % 10).alias("provider"))
    return merge.superseded(d, b, "id", "title", "provider").select(F.col("id").alias("doc_id"))


@query("SELECT sha256(coalesce(text, '')) AS raw_sha256, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1")
def dedupe_min_id(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(hashing.sha256(F.coalesce("text", F.lit(""))).alias("raw_sha256")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))


@query("""SELECT CAST(event_id AS VARCHAR) AS record_id, '/user_id' AS path, 'conflict.event_type' AS code, 'error' AS severity FROM events
    QUALIFY event_type <> first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)""")
def batch_conflict_first_seen(spark, sf_dir):
    return validation.conflicts(read(spark, sf_dir, "events"), "user_id", F.col("event_type"), F.struct("ts", "event_id"), F.col("event_id"), "conflict.event_type")


@query("SELECT CAST(event_id AS VARCHAR) AS record_id, '/user_id' AS path, 'duplicate.user' AS code, 'error' AS severity FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def duplicate_keys(spark, sf_dir):
    return validation.duplicates(read(spark, sf_dir, "events"), "user_id", F.col("event_id"), F.col("event_id"), "duplicate.user")


def slices(spark, sf_dir):
    """All orders as they are stored, and as they come in: some with another status, some under a new key, so that these are new and the old ones retained."""
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    new = old.withColumns({"o_orderstatus": F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderkey": F.when(key % 5 == 0, -key).otherwise(key)})
    return old, new


SLICES = """o AS (SELECT * FROM orders), n AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey) FROM orders)"""


@query(f"""WITH {SLICES} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus,
    CASE WHEN n.o_orderkey IS NULL THEN 'retained' WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderstatus = o.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def merge_full_outer(spark, sf_dir):
    old, new = slices(spark, sf_dir)
    return merge.merged(old, new, ["o_orderkey"], ["o_orderstatus"])


@query(f"WITH {SLICES} SELECT o.o_orderkey, '/o_orderstatus' AS path, 'modified' AS change, o.o_orderstatus AS old, n.o_orderstatus AS new FROM o JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderstatus <> n.o_orderstatus")
def record_diff(spark, sf_dir):
    old, new = slices(spark, sf_dir)
    return merge.record_diff(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(f"""WITH {SLICES}, p AS (SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderstatus = o.o_orderstatus THEN 'unchanged' WHEN n.o_orderkey % 2 = 0 THEN 'pending_review' ELSE 'updated' END AS action FROM n LEFT JOIN o ON o.o_orderkey = n.o_orderkey)
    SELECT a.action, count(p.o_orderkey) AS n FROM (VALUES ('created'), ('updated'), ('unchanged'), ('rejected'), ('pending_review')) a(action) LEFT JOIN p ON p.action = a.action GROUP BY 1""")
def import_plan_counts(spark, sf_dir):
    old, new = slices(spark, sf_dir)
    stored = old.withColumns({"fetched": F.lit(10), "version": F.lit(1)})
    coming = new.withColumn("fetched", F.when(F.col("o_orderkey") % 2 == 0, 9).otherwise(11))
    return merge.action_counts(merge.plan(coming, stored, "o_orderkey", ["o_orderstatus"], "fetched"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS record_id, '/l_suppkey' AS path, 'reference.supplier' AS code, 'error' AS severity FROM lineitem WHERE l_quantity = 1 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '/o_orderkey', 'reference.unused', 'warning' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def referential_issues(spark, sf_dir):
    l, o, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    asked = l.withColumn("l_suppkey", F.when(F.col("l_quantity") == 1, -1 - F.col("l_suppkey")).otherwise(F.col("l_suppkey")))  # no supplier has such a key
    orphans = validation.missing_references(asked, s, "l_suppkey", "s_suppkey", F.col("l_orderkey"), F.lit("/l_suppkey"), "reference.supplier")
    return orphans.union(validation.unreferenced(o, l, "o_orderkey", "l_orderkey", F.col("o_orderkey"), F.lit("/o_orderkey"), "reference.unused"))


@query("""WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'range' WHEN 2 THEN 'pooled_total' ELSE 'unspecified' END AS kind, o_orderkey % 3 AS r FROM orders)
    SELECT CAST(k AS VARCHAR) AS record_id, '/amount/minimum' AS path, 'amount.missing_field' AS code, 'error' AS severity FROM a WHERE kind = 'range' AND r = 0
    UNION ALL SELECT CAST(k AS VARCHAR), '/amount', 'amount.range_inverted', 'error' FROM a WHERE kind = 'range' AND r = 1
    UNION ALL SELECT CAST(k AS VARCHAR), '/amount', 'amount.pooled_total_unit', 'error' FROM a WHERE kind = 'pooled_total'
    UNION ALL SELECT CAST(k AS VARCHAR), '/amount/fixed', 'amount.unexpected_field', 'error' FROM a WHERE kind = 'unspecified' AND r = 2
    UNION ALL SELECT CAST(k AS VARCHAR), '/amount', 'amount.currency_required', 'error' FROM a WHERE kind = 'unspecified' AND r = 2
    UNION ALL SELECT CAST(k AS VARCHAR), '/amount/fixed', 'amount.bad_decimal', 'error' FROM a WHERE kind = 'fixed' AND r = 1""")
def amount_validation_issues(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k, r = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    kind = F.when(k == 0, "fixed").when(k == 1, "range").when(k == 2, "pooled_total").otherwise("unspecified")
    values = {
        "fixed": F.when((kind == "fixed") & (r == 1), "5e3").when((kind == "fixed") | ((kind == "unspecified") & (r == 2)), "100"),
        "minimum": F.when((kind == "range") & (r == 1), "900").when((kind == "range") & (r == 2), "5.50"),
        "maximum": F.when(kind == "range", "800"),
        "pooled_total": F.when(kind == "pooled_total", "1000000"),
    }
    codes = money.issues(kind, values, F.lit("per_student"), F.when(kind != "unspecified", "CAD"), F.lit("as stated"))
    return validation.exploded(o, F.col("o_orderkey"), codes, F.lit("/amount"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def version_revisions(spark, sf_dir):
    v = merge.versions(read(spark, sf_dir, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey"))
    return v.select("o_orderkey", "o_custkey", F.col("version").cast("long").alias("version"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), h AS (SELECT *, length(t) < 30 AS head FROM l)
    SELECT doc_id, pos, last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER w AS heading, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def block_headings(spark, sf_dir):
    lines = documents.paragraphs(read(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    marked = documents.with_headings(lines, "doc_id", F.length("text") < 30)
    return marked.select("doc_id", F.col("pos").cast("long").alias("pos"), "heading", "section")


#: Quotes whose words every executor may hold.
FEW_QUOTES = 100_000


@query("SELECT d.doc_id, b.item_id, CAST(instr(d.text, b.text) - 1 AS INTEGER) AS text_start FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_locate(spark, sf_dir):
    # Quotes meet texts at one word, their longest inner one; whether a text holds the whole quote is then looked up.
    # The first and the last word may be parts of a text's words, so quotes without an inner one are looked up in all texts.
    d, b = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    parts = F.split("quote", r"\s+")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    keyed = b.withColumn("word", F.get(F.array_sort(inner, lambda x, y: F.length(y) - F.length(x)), 0))
    # Texts stay out of the join by words: only ids and words are shuffled.
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    wanted = keyed.where("word is not null").select("word", "item_id")
    # Few quotes go to the texts, so that no word is shuffled; many meet the words by a shuffle.
    few = b.limit(FEW_QUOTES + 1).count() <= FEW_QUOTES
    pairs = words.join(F.broadcast(wanted) if few else wanted, "word").select("doc_id", "item_id").distinct()
    held = F.contains("text", F.col("quote"))
    columns = ["doc_id", "text", "item_id", "quote"]
    hits = d.join(pairs, "doc_id").join(b, "item_id").where(held).select(columns).union(d.join(keyed.where("word is null"), held).select(columns))
    return hits.select("doc_id", "item_id", (F.instr(F.col("text"), F.col("quote")) - 1).alias("text_start"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS INTEGER) AS n_links,
    CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS INTEGER) AS n_headings, CAST(length(html) AS INTEGER) AS n_chars FROM pages""")
def html_page_facts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", *documents.page_facts(F.col("html")))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^&]*|gclid=[^&]*)(&|$)', '\1'), '[?&]$', '') AS canonical FROM pages""")
def url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '://([^/?#]*)', 1) LIKE '%.example.org' THEN NULL ELSE 'not_allowed' END AS refusal FROM pages")
def url_safety(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.refusal(F.col("url"), [("*.example.org", "/")]).alias("refusal"))


@query(r"""SELECT p_partkey, 'part:' || regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS id FROM part""")
def slug_ids(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.record_id(F.lit("part"), F.col("p_name")).alias("id"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 89) || '-' || left(sha1(text), 10) END AS id FROM documents")
def stable_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.stable_id(F.col("text")).alias("id"))


@query("SELECT doc_id, 'snap_' || left(sha256(text), 20) AS snapshot, left(sha256('/summary' || chr(31) || 'snap_' || left(sha256(text), 20) || chr(31) || text), 16) AS evidence FROM documents")
def evidence_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("snapshot", hashing.snapshot_id(F.col("text")))
    return d.select("doc_id", "snapshot", hashing.evidence_id(F.lit("/summary"), F.col("snapshot"), F.col("text")).alias("evidence"))


@query("""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'maximum' WHEN 2 THEN 'range' ELSE 'unspecified' END AS kind,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(x AS DOUBLE) END AS fixed, CASE WHEN o_orderkey % 4 = 2 THEN CAST(x AS DOUBLE) END AS minimum, CASE o_orderkey % 4 WHEN 1 THEN CAST(x AS DOUBLE) WHEN 2 THEN CAST(x + 500 AS DOUBLE) END AS maximum FROM o""")
def money_from_text(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("x"))
    x, y = F.format_number("x", 0), F.format_number(F.col("x") + 500, 0)
    k = F.col("o_orderkey") % 4
    words = F.when(k == 0, F.concat(F.lit("$"), x)).when(k == 1, F.concat(F.lit("Up to $"), x)).when(k == 2, F.concat(F.lit("$"), x, F.lit(" - $"), y)).otherwise("Varies")
    made = o.select("o_orderkey", money.from_text(words).alias("a"))
    return made.select("o_orderkey", "a.kind", *(F.col(f"a.{c}").cast("double").alias(c) for c in ("fixed", "minimum", "maximum")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS plain, CAST(NULL AS VARCHAR) AS refused FROM orders")
def decimal_canonical(spark, sf_dir):
    written = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".00").otherwise(".50"))
    return read(spark, sf_dir, "orders").select("o_orderkey", money.canonical_decimal(written).alias("plain"), money.canonical_decimal(F.lit("5e3")).alias("refused"))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}') OR regexp_matches(text, '(?i)\b(status card|registry|passport|sin|card)\s*(number|no\.?|#)?\s*[:#]?\s*\d{5,}') AS sensitive FROM conversations""")
def sensitive_text_flag(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.sensitive(F.col("text")).alias("sensitive"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events")
def json_roundtrip(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("r"), hashing.canonical_json("props").alias("canonical"))
    return e.select("event_id", "r.k", "canonical")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streams.windowed_counts(e, "ts", "event_type", "value")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def event_upserts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = streams.newest(e.where("event_id % 2 = 0"), "user_id", "event_id")
    return streams.upserted(streams.upserted(first, e.where("event_id % 2 = 1"), "user_id", "event_id"), e, "user_id", "event_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def utc_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.utc_text(F.col("o_orderdate").cast("timestamp")).alias("at"))
