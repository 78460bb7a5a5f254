"""Records, findings and imports on the driver's tables: orders are records, their lines are cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import availability, matching, merge, records, validation
from ..sources import tables
from .data_queries import SLICES, slices
from .rule_queries import AS_OF
from .tables import query, read


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), "l_partkey", "l_suppkey")


@query("""WITH l AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(parts, '') AS parts, CAST(coalesce(n, 0) AS INTEGER) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def record_assembly(spark, sf_dir):
    parents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    children = lines(spark, sf_dir).withColumnRenamed("l_orderkey", "id")
    whole = records.assembled({"opportunities": parents, "cycles": children.select("id", "position", "l_partkey"), "evidence": children.select("id", "position", "l_suppkey")})
    return whole.select(F.col("id").alias("o_orderkey"), F.array_join(F.transform("cycles", lambda c: c.l_partkey.cast("string")), ",").alias("parts"), F.size("evidence").alias("n"))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS position, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def record_child_rows(spark, sf_dir):
    parents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    whole = records.nested(parents, lines(spark, sf_dir).select("l_orderkey", "position", "l_partkey"), "l_orderkey", "cycles")
    return records.unnested(whole, "l_orderkey", "cycles").withColumnRenamed("record_id", "l_orderkey")


GATE = """CASE o_orderstatus WHEN 'P' THEN 'draft' ELSE 'published' END AS publication_status, CASE o_orderpriority WHEN '1-URGENT' THEN 'award_collection' ELSE 'award' END AS opportunity_type,
    CASE o_orderkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' WHEN 2 THEN 'unknown' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'unknown' ELSE 'applies' END AS province"""


def gated(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "closed").when(k % 4 == 1, "open").when(k % 4 == 2, "unknown")
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("publication_status"), F.when(F.col("o_orderpriority") == "1-URGENT", "award_collection").otherwise("award").alias("opportunity_type"), F.struct(status.alias("status")).alias("availability"), F.when(k % 3 == 0, "not_applicable").when(k % 3 == 1, "unknown").otherwise("applies").alias("province"))


@query(f"""WITH g AS (SELECT o_orderkey, {GATE} FROM orders), p AS (SELECT * FROM g WHERE publication_status = 'published' AND status IS NOT NULL)
    SELECT o_orderkey, 'plain' AS listing FROM p WHERE opportunity_type = 'award' AND status <> 'closed' AND province <> 'not_applicable'
    UNION ALL SELECT o_orderkey, 'collections' FROM p WHERE opportunity_type = 'award_collection' AND province = 'applies'""")
def listing_gate(spark, sf_dir):
    g = gated(spark, sf_dir)
    plain = records.gate(g, applicability=["province"])
    collections = records.gate(g, "award_collection", include_closed=True, applicability=["province"], exclude_unknown=True)
    return plain.select("o_orderkey", F.lit("plain").alias("listing")).union(collections.select("o_orderkey", F.lit("collections").alias("listing")))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS y, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderstatus <> 'P' AS shown FROM orders),
    m AS (SELECT o_custkey, y, list(struct_pack(k := o_orderkey, t := o_orderpriority) ORDER BY o_orderkey) AS a FROM o WHERE shown GROUP BY ALL)
    SELECT o_orderkey, y AS cycle_key, CAST(coalesce(len(list_filter(m.a, lambda x: x.k <> o_orderkey)), 0) AS INTEGER) AS n_shared, coalesce(array_to_string(list_transform(list_filter(m.a, lambda x: x.k <> o_orderkey), lambda x: x.t), ','), '') AS titles,
        CASE WHEN d < '{AS_OF[:10]}' THEN 'closed' WHEN d = '{AS_OF[:10]}' THEN 'not_closed' ELSE 'not_closed' END AS state FROM o LEFT JOIN m USING (o_custkey, y)""")
def record_detail(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    deadline = F.struct(F.lit("date").alias("kind"), day.alias("date"), F.lit(None).cast("string").alias("local_time"), F.lit("America/Toronto").alias("timezone"))
    cycle = F.struct(F.year("o_orderdate").cast("string").alias("cycle_key"), F.lit(None).cast("string").alias("starts_on"), F.lit(None).cast("string").alias("ends_on"), F.array(deadline).alias("deadlines"), F.struct(F.lit("fixed").alias("kind")).alias("amount"), F.lit(False).alias("group_stated"), F.lit(None).cast("string").alias("application_group_id"))
    whole = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("publication_status"), F.struct(F.col("o_custkey").cast("string").alias("group_id")).alias("application"), F.array(cycle).alias("cycles"))
    seen = records.detail(whole, F.lit(dates.as_of_seconds(AS_OF)))
    return seen.select(F.col("id").alias("o_orderkey"), "cycle_key", F.size("shared_with").alias("n_shared"), F.array_join("shared_with", ",").alias("titles"), F.get("deadlines", 0).state.alias("state"))


CASES = "deadline.date_required:date deadline.time_required:local_time deadline.kind_time_mismatch:local_time deadline.unexpected_field:annual_day deadline.annual_fields deadline.annual_invalid deadline.annual_no_concrete_date:date deadline.unexpected_fields deadline.timezone_unrecognised:timezone deadline.utc_not_exact:deadline_at_utc deadline.utc_tz_rules_changed:deadline_at_utc deadline.utc_mismatch:deadline_at_utc deadline.year_not_supported deadline.precision_mismatch:precision".split()


def _case_sql(k: int, code: str) -> str:
    name, _, field = code.partition(":")
    path = f"/deadline/{field}" if field else "/deadline"
    return f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, '{path}' AS path, '{name}' AS code, '{'warning' if name in validation.WARNINGS else 'error'}' AS severity FROM orders WHERE o_orderkey % 15 = {k}"


@query(" UNION ALL ".join(_case_sql(k, c) for k, c in enumerate(CASES)))
def deadline_issue_codes(spark, sf_dir):
    """Each order's deadline breaks one rule, by its key modulo 15; the last breaks none."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 15
    at = lambda *cases: k.isin(*cases)
    none = F.lit(None).cast("string")
    kind = F.when(at(0, 3, 8, 9, 10, 11, 12, 13, 2, 14), "date").when(at(1), "datetime").when(at(4, 5, 6), "annual_rule").otherwise("rolling")
    d = F.struct(
        kind.alias("kind"),
        F.when(at(1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13, 14), "2026-07-01").alias("date"),
        F.when(at(2), "12:00").alias("local_time"),
        F.when(at(5), 2).when(at(6), 7).alias("annual_month"),
        F.when(at(3), 1).when(at(5), 30).when(at(6), 1).alias("annual_day"),
        # A date closes at the end of its local day: 4 hours after UTC's in Toronto in summer.
        F.when(at(9), "2026-07-02T04:00:00Z").when(at(10), "2026-07-02T05:00:00Z").when(at(11), "2026-07-02T09:00:00Z").when(at(14), "2026-07-02T04:00:00Z").otherwise(none).alias("deadline_at_utc"),
        F.when(at(8), "local custom").when(at(9), none).when(kind.isin("date", "datetime"), "America/Toronto").alias("timezone"),
        F.when(at(13), "month_day").when(kind == "date", "day").when(kind == "datetime", "minute").when(kind == "annual_rule", "month_day").otherwise("none").alias("precision"),
        none.alias("derived_from"),
    )
    quotes = F.when(at(12), F.array(F.lit("by July 1"))).otherwise(F.array(F.lit("by July 1, 2026")))
    with_d = o.select("o_orderkey", d.alias("d"), quotes.alias("quotes"))
    return validation.exploded(with_d, F.col("o_orderkey"), validation.deadline_codes(F.col("d"), F.col("quotes"), F.lit("2025"), F.lit("one year")), F.lit("/deadline"))


@query(f"""WITH {SLICES}, p AS (SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderstatus = o.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS action, n.o_orderstatus = 'X' AS bad FROM n LEFT JOIN o ON o.o_orderkey = n.o_orderkey)
    SELECT 'partial' AS mode, action, CASE WHEN bad THEN 'rejected' ELSE 'applied' END AS outcome, count(*) AS n FROM p GROUP BY ALL
    UNION ALL SELECT 'dry_run', action, CASE WHEN bad THEN 'rejected' ELSE 'planned' END, count(*) FROM p GROUP BY ALL
    UNION ALL SELECT 'all_or_nothing', action, CASE WHEN bad THEN 'rejected' WHEN (SELECT bool_or(bad) FROM p) THEN 'held' ELSE 'applied' END, count(*) FROM p GROUP BY ALL""")
def import_gate_outcomes(spark, sf_dir):
    old, new = slices(spark, sf_dir)
    planned = merge.plan(new.withColumn("fetched", F.lit(11)), old.withColumns({"fetched": F.lit(10), "version": F.lit(1)}), "o_orderkey", ["o_orderstatus"], "fetched")
    issues = validation.found(new, F.col("o_orderkey"), F.lit("/o_orderstatus"), F.when(F.col("o_orderstatus") == "X", "schema.enum"))
    out = None
    for mode in ("partial", "dry_run", "all_or_nothing"):
        one = merge.import_gate(planned, issues, "o_orderkey", mode).groupBy("action", "outcome").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "action", "outcome", "n")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {SLICES} SELECT CAST(o_orderkey AS VARCHAR) AS record_id, '/o_orderstatus' AS path, 'schema.enum' AS code,
    '{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}' AS record FROM n WHERE o_orderstatus = 'X'""")
def quarantine_rows(spark, sf_dir):
    _, new = slices(spark, sf_dir)
    issues = validation.found(new, F.col("o_orderkey"), F.lit("/o_orderstatus"), F.when(F.col("o_orderstatus") == "X", "schema.enum"))
    return merge.quarantined(new, issues, "o_orderkey")


@query("""SELECT o_orderkey, '/a/0/status' AS path, 'modified' AS change, '"' || o_orderstatus || '"' AS old, '"X"' AS new FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, '/a/1', 'added', NULL, '{}' FROM orders WHERE o_orderkey % 3 = 1
    UNION ALL SELECT o_orderkey, '/b~1c', 'removed', CAST(o_custkey AS VARCHAR), NULL FROM orders WHERE o_orderkey % 3 = 2""")
def document_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    text = lambda status, more, tail: F.concat(F.lit('{"a": [{"status": "'), status, F.lit('"}'), more, F.lit("]"), tail, F.lit("}"))
    by = F.concat(F.lit(', "b/c": '), F.col("o_custkey").cast("string"))
    old = o.select("o_orderkey", text(F.col("o_orderstatus"), F.lit(""), by).alias("doc"))
    new = o.select("o_orderkey", text(F.when(k == 0, "X").otherwise(F.col("o_orderstatus")), F.when(k == 1, ", {}").otherwise(""), F.when(k == 2, "").otherwise(by)).alias("doc"))
    return merge.document_diff(old, new, "o_orderkey", "doc")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS p FROM lineitem GROUP BY ALL), c AS (SELECT o_orderkey, unnest([3, 1, 3, 9, 2]) AS id, unnest([1, 2, 9, 4, 5]) AS pos FROM orders)
    SELECT o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY pos) AS refs FROM c JOIN l ON l_orderkey = o_orderkey AND l_linenumber = id WHERE pos <> 9 GROUP BY 1""")
def cited_evidence(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("id")).distinct()
    refs = matching.cited(o, e, "o_orderkey", F.array(*map(F.lit, (3, 1, 3, 9, 2))))
    return refs.select("o_orderkey", F.array_join(F.transform("refs", lambda r: r.id.cast("string")), ",").alias("refs"))


@query(f"WITH {SLICES} SELECT o_orderkey, o_orderstatus FROM n UNION ALL SELECT o_orderkey, o_orderstatus FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def union_by_key(spark, sf_dir):
    old, new = slices(spark, sf_dir)
    return merge.union_by_key(old.select("o_orderkey", "o_orderstatus"), new.select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'machine_checked' WHEN 2 THEN 'human_reviewed' END AS a, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'machine_checked' WHEN 2 THEN 'human_reviewed' ELSE 'rejected' END AS b,
        CASE o_orderkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'published' ELSE 'archived' END AS p, CASE o_orderkey % 7 WHEN 0 THEN 'published' ELSE 'draft' END AS q FROM orders),
    s AS (SELECT *, CASE WHEN b = 'rejected' THEN b WHEN list_position(['pending', 'machine_checked', 'human_reviewed'], coalesce(a, 'pending')) >= list_position(['pending', 'machine_checked', 'human_reviewed'], b) THEN coalesce(a, b) ELSE b END AS review FROM r)
    SELECT o_orderkey, review, CASE WHEN review = 'rejected' THEN 'draft' WHEN 'archived' IN (p, q) THEN 'archived' WHEN 'published' IN (p, q) AND review IN ('machine_checked', 'human_reviewed') THEN 'published' ELSE q END AS publication FROM s""")
def settled_status(spark, sf_dir):
    k = F.col("o_orderkey")
    name = lambda n: F.when(k % n == 0, "pending").when(k % n == 1, "machine_checked").when(k % n == 2, "human_reviewed")
    r = read(spark, sf_dir, "orders").select("o_orderkey", merge.settled_review(name(4), name(5).otherwise("rejected")).alias("review"))
    p, q = F.when(k % 3 == 0, "draft").when(k % 3 == 1, "published").otherwise("archived"), F.when(k % 7 == 0, "published").otherwise("draft")
    return r.withColumn("publication", merge.settled_publication(p, q, F.col("review")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',2024-02-29' AS found FROM orders")
def stated_dates(spark, sf_dir):
    said = F.concat(F.lit("Opens "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("; not February 30, 2023 but February 29, 2024."))
    found = dates.stated_dates(said)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda d: d.cast("string")), ",").alias("found"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1995-06-17' THEN 'open' ELSE 'closed' END WHEN 1 THEN 'open' WHEN 2 THEN 'annual' ELSE 'unknown' END AS status FROM orders""")
def listed_availability(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    first = F.struct(F.when(k == 0, "date").when(k == 1, "rolling").when(k == 2, "annual_rule").otherwise("unspecified").alias("kind"), F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    other = F.struct(F.lit("unspecified").alias("kind"), F.lit(None).cast("string").alias("date"))
    return read(spark, sf_dir, "orders").select("o_orderkey", availability.listed_availability(F.array(other, first), F.lit("1995-06-17").cast("date")).alias("status"))


@query("""SELECT o_orderkey, o_orderkey % 3 <> 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 5 < 2) AS changed,
    'Read the official page: u' || CASE o_orderkey % 3 WHEN 0 THEN '|Contact the administrator to apply or to learn the local deadline: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'c' ELSE 'u' END WHEN 1 THEN '|Apply here: a' ELSE '' END
    || CASE WHEN o_orderkey % 2 = 0 THEN '|Prepare: form, ' || o_orderpriority ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '|This form is shared with: x. Each award has its own eligibility rules.' ELSE '' END AS steps FROM orders""")
def record_next_steps(spark, sf_dir):
    k = F.col("o_orderkey")
    changed, verified = F.when(k % 3 != 0, F.lit(20)), F.when(k % 2 != 0, F.when(k % 5 < 2, 10).otherwise(30))
    names = lambda c, *v: F.when(c, F.array(*v)).otherwise(F.array().cast("array<string>"))
    steps = records.next_steps(F.lit("u"), F.when(k % 3 == 0, "contact_administrator").otherwise("online"), F.when(k % 3 == 1, "a"), F.when(k % 2 == 0, "c"), F.lit(None).cast("string"), names(k % 2 == 0, F.lit("form"), F.col("o_orderpriority")), names(k % 5 == 0, F.lit("x")))
    return read(spark, sf_dir, "orders").select("o_orderkey", records.changed_since_verified(changed, verified).alias("changed"), F.array_join(steps, "|").alias("steps"))


@query("SELECT sha256(text) AS raw_sha256, min(CAST(doc_id AS VARCHAR)) AS path FROM documents WHERE text IS NOT NULL GROUP BY 1")
def raw_contents(spark, sf_dir):
    files = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return tables.raw_store(files).select("raw_sha256", "path")


@query("SELECT p_partkey, strip_accents(replace(lower(p_name || ' ÉTÉ Straße'), 'ß', 'ss')) AS folded, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' 1 2 fin' AS compared FROM part")
def folded_names(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", text.fold_exact(F.concat(name, F.lit(" ÉTÉ Straße"))).alias("folded"), text.comparison(F.concat(name, F.lit(" ½ ﬁn"))).alias("compared"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
    SELECT k AS o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN k % 3 = 0 THEN 'deadline_unknown' END, CASE WHEN k % 5 = 0 THEN 'never_verified' END, CASE WHEN k % 5 <> 0 AND k % 7 > 3 THEN 'verification_stale' END,
        CASE WHEN k % 2 = 1 THEN 'cycle_unspecified' END, CASE WHEN k % 3 = 1 THEN 'amount_unknown' END, CASE WHEN k % 4 <> 1 THEN 'eligibility_not_fully_structured' END, CASE WHEN k % 4 = 0 THEN 'historical_cycle_only' END,
        CASE WHEN k % 6 = 0 THEN 'source_changed_since_verification' END], lambda x: x IS NOT NULL)), ',') AS flags FROM o""")
def freshness_flags(spark, sf_dir):
    k, as_of = F.col("o_orderkey"), dates.as_of_seconds(AS_OF)
    seen = F.struct(F.when(k % 4 == 0, "closed").otherwise("open").alias("status"), F.when(k % 3 == 0, F.array(F.lit("deadline_unknown"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    verified = F.when(k % 5 != 0, F.lit(as_of) - k % 7 * 10 * dates.DAY)
    flags = availability.freshness_flags(seen, verified, F.lit(as_of), 30, F.when(k % 2 == 1, "unspecified").otherwise("c"), F.when(k % 3 == 1, "unspecified").otherwise("fixed"), k % 4 == 1, k % 6 == 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(flags, ",").alias("flags"))
