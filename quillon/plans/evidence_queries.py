"""Documents as VARIANT: pointers, citations and evidence; quotes verified in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical
from ..operators import pointers, quotes
from .tables import query, read


def cited_documents(spark, sf_dir):
    """A document for each order: a cycle for each line, citing evidence named after suppliers; the evidence points at fields by cycle keys and by places."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    lines = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(order)).alias("lines"))
    none = F.array().cast("array<string>")
    key = lambda x, i: F.concat(F.lit("part/"), x.l_partkey.cast("string"), F.lit("~"), i.cast("string"))
    cycle = lambda x, i: F.struct(
        key(x, i).alias("cycle_key"),
        F.struct(x.l_extendedprice.alias("fixed"), F.when(x.l_linestatus == "O", F.array(name(x.l_suppkey))).otherwise(none).alias("evidence_ids")).alias("amount"),
        F.array(F.struct(x.l_shipdate.cast("date").cast("string").alias("date"), F.when(x.l_quantity > 40, F.array(name(x.l_suppkey + 1))).otherwise(none).alias("evidence_ids"))).alias("deadlines"),
    )
    token = lambda x, i: F.concat(F.lit("/cycles/part~1"), x.l_partkey.cast("string"), F.lit("~0"), i.cast("string"))
    path = lambda x, i: F.when(x.l_returnflag == "R", F.concat(token(x, i), F.lit("/deadlines/1"))).when(x.l_returnflag == "A", F.concat(token(x, i), F.lit("/amount"))).otherwise(F.concat(F.lit("/cycles/"), i.cast("string"), F.lit("/deadlines/0")))
    item = lambda x, i: F.struct(name(x.l_suppkey).alias("id"), path(x, i).alias("field_path"))
    made = o.join(lines, "o_orderkey").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.transform("lines", cycle).alias("cycles"), F.transform("lines", item).alias("evidence"))).alias("json"))
    return made.select("o_orderkey", F.parse_json("json").alias("document"))


#: Lines with their place in the order, and the evidence and citations that they make.
CITED = """l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, l_quantity, l_shipdate) - 1 AS i, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    k AS (SELECT *, '/cycles/part~1' || l_partkey || '~0' || i AS cycle FROM l),
    e AS (SELECT l_orderkey, i, 'e' || l_suppkey AS id, CASE l_returnflag WHEN 'R' THEN cycle || '/deadlines/1' WHEN 'A' THEN cycle || '/amount' ELSE '/cycles/' || i || '/deadlines/0' END AS field_path, l_returnflag <> 'R' AS resolved FROM k),
    c AS (SELECT l_orderkey, cycle || '/amount' AS path, 'e' || l_suppkey AS id FROM k WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, cycle || '/deadlines/0', 'e' || (l_suppkey + 1) FROM k WHERE l_quantity > 40),
    n AS (SELECT l_orderkey, id, max_by(field_path, i) AS field_path, max(i) AS i FROM e GROUP BY l_orderkey, id)"""


@query(f"""WITH {CITED}, f AS (
    SELECT l_orderkey, '/evidence/' || i || '/id' AS path, 'evidence.duplicate_id' AS code, 'error' AS severity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY i) AS r FROM e) WHERE r > 1
    UNION ALL SELECT l_orderkey, '/evidence/' || i || '/field_path', 'evidence.field_path_unresolved', 'error' FROM e WHERE NOT resolved
    UNION ALL SELECT c.l_orderkey, c.path, CASE WHEN n.i IS NULL THEN 'evidence.unknown_id' ELSE 'evidence.wrong_field' END, 'error' FROM c LEFT JOIN n USING (l_orderkey, id) WHERE n.i IS NULL OR NOT (n.field_path = c.path OR starts_with(n.field_path, c.path || '/') OR starts_with(c.path, n.field_path || '/'))
    UNION ALL SELECT n.l_orderkey, '/evidence/' || i, 'evidence.unreferenced', 'warning' FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = n.l_orderkey AND c.id = n.id))
    SELECT CAST(l_orderkey AS VARCHAR) AS record_id, path, code, severity FROM f""")
def evidence_index(spark, sf_dir):
    return pointers.evidence_findings(cited_documents(spark, sf_dir), "o_orderkey", "document", depth=6)


@query(f"""WITH {CITED} SELECT l_orderkey AS o_orderkey, CAST(e.i AS INTEGER) AS at, field_path, CASE WHEN l_returnflag = 'N' THEN CAST(e.i AS VARCHAR) ELSE 'part/' || l_partkey || '~' || e.i END AS cycle,
    CASE WHEN l_returnflag = 'N' THEN strftime(l_shipdate, '%Y-%m-%d') END AS date FROM e JOIN k USING (l_orderkey, i)""")
def pointer_lookups(spark, sf_dir):
    d = cited_documents(spark, sf_dir)
    items = F.try_variant_get("document", F.lit("$.evidence"), "array<struct<id string, field_path string>>")
    read = d.select("o_orderkey", items.alias("items"), F.to_json("document").alias("json"))
    read = read.withColumn("led", pointers.all_looked_up("json", F.transform("items", lambda e: e.field_path)))
    each = read.select("o_orderkey", F.posexplode(F.arrays_zip(F.col("items.field_path").alias("field_path"), "led")).alias("at", "e")).select("o_orderkey", "at", "e.*")
    date = F.try_variant_get(F.try_parse_json("led"), F.lit("$.date"), "string")
    return each.select("o_orderkey", "at", "field_path", pointers.cycle_of(F.col("field_path")).alias("cycle"), date.alias("date"))


#: Texts with pages, headings, wide spaces, curly quotes, soft hyphens and wide letters; one raw character of the given text becomes one or two.
def dressed(text):
    return F.replace(F.replace(F.replace(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("'"), F.lit("’")), F.lit("t"), F.lit("ｔ")), F.lit("e"), F.lit("e­"))


@query(r"""WITH p AS (SELECT d.doc_id, b.item_id, d.text, b.text AS quote FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    s AS (SELECT *, trim(regexp_replace(replace(quote, chr(8217), ''''), '\s+', ' ', 'g')) AS words, left(text, instr(text, quote) - 1) AS before FROM p)
    SELECT doc_id, item_id, 2 AS page, 1 AS paragraph_index, 'Text' AS heading, words, CAST(16 + length(before) + len(regexp_extract_all(before, '[ e\n]')) AS INTEGER) AS raw_start FROM s""")
def quote_offsets(spark, sf_dir):
    from .data_queries import quote_locate

    # A text of one block on the second page, so that quotes with blank lines inside stay whole: its lines are parted by single breaks.
    one = lambda c: F.regexp_replace(c, "\n", " ")
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# One\n\n\f# Text\n\n"), dressed(one(F.col("text")))).alias("raw"))
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    asked = quote_locate(spark, sf_dir).select("doc_id", "item_id").join(F.broadcast(b), "item_id")
    found = quotes.located(asked, d, "doc_id", "raw")
    words = canonical(quotes.cut(F.col("raw"), F.col("raw_start"), F.col("raw_end")))
    return found.join(d, "doc_id").select("doc_id", "item_id", "page", "paragraph_index", "heading", words.alias("words"), "raw_start")


def snapshots(spark, sf_dir):
    """A snapshot for each document (some without raw or text, some not UTF-8), a reference, and one item of evidence that is wrong in a way that the document's columns choose."""
    d = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    c, line = F.col, F.get(F.split("text", "\n"), 0)
    body = F.concat(F.lit("# "), F.coalesce("lang", F.lit("none")), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\f# Tail\n\nkept by "), F.coalesce("source", F.lit("nobody")))
    made = d.select("doc_id", "lang", "source", "n_chars", line.alias("line"), body.alias("body"))
    missing, bad = c("n_chars") < 60, (c("n_chars") > 3000) & (c("n_chars") < 3200)
    binary = F.when(bad, F.concat(F.col("body").cast("binary"), F.unhex(F.lit("ff")))).otherwise(c("body").cast("binary"))
    files = made.select(c("doc_id").alias("snapshot_id"), F.when(~(c("n_chars") < 40), c("body").cast("binary")).alias("raw"), F.when(~missing, binary).alias("text"))
    sha = F.sha2(c("body").cast("binary"), 256)
    refs = made.where("source <> 'src1'").select(c("doc_id").alias("record_id"), c("doc_id").alias("snapshot_id"), "source", F.col("source").alias("source_id"), sha.alias("raw_sha256"), F.when(c("source") == "src3", F.sha2(F.lit("x"), 256)).otherwise(F.sha2(binary, 256)).alias("text_sha256")).drop("source")
    quote = F.when(c("lang") == "fr", F.concat("line", F.lit(" zzz"))).when(c("lang") == "de", F.lit("kept  by")).when((c("lang") == "es") & (c("n_chars") > 2500), F.concat(F.repeat(F.lit("q"), 501))).otherwise(F.substring("line", 1, 60))
    long = c("n_chars") > 500
    e = made.select(
        c("doc_id").alias("record_id"), F.lit(0).alias("at"), c("doc_id").alias("snapshot_id"), F.when(c("source") == "src0", "other").otherwise(c("source")).alias("source_id"), sha.alias("raw_sha256"), F.when(c("source") == "src2", "no").otherwise(F.sha2(binary, 256)).alias("text_sha256"),
        quote.alias("quote"), F.when(c("lang") == "es", 7 - 6 * (c("n_chars") < 1500).cast("int")).otherwise(1).alias("pdf_page"), F.when(c("lang") == "es", 100000).when(c("lang") != "de", 1).alias("paragraph_index"),
        F.when(c("lang") == "en", F.when(long, 0).otherwise(1)).alias("text_start"), F.when(c("lang") == "en", F.length(canonical(quote))).alias("text_end"), F.when((c("lang") == "en") & (c("n_chars") > 900), "English").when(c("lang") == "en", "en").alias("heading"))
    return e, refs, files


@query(r"""WITH d AS (SELECT doc_id, lang, source, n_chars, string_split(coalesce(text, ''), chr(10))[1] AS line, text FROM documents),
    s AS (SELECT *, source = 'src1' OR source IS NULL AS noref, n_chars < 40 AS noraw, n_chars < 60 AS notext, n_chars > 3000 AND n_chars < 3200 AS bad, trim(regexp_replace(left(line, 60), '\s+', ' ', 'g')) AS head FROM d),
    t AS (SELECT *, NOT noref AND NOT noraw AND NOT notext AND NOT bad AS loaded, CASE WHEN lang = 'fr' OR lang = 'de' OR (lang = 'es' AND n_chars > 2500) THEN 'x' ELSE head END AS q FROM s),
    f AS (SELECT doc_id, unnest(list_filter([
        CASE WHEN noref THEN 'evidence.snapshot_ref_missing:/snapshot_id' END,
        CASE WHEN NOT noref AND source = 'src0' THEN 'evidence.source_mismatch:/source_id' END,
        CASE WHEN NOT noref AND noraw THEN 'evidence.raw_missing:' END,
        CASE WHEN NOT noref AND notext THEN 'evidence.text_missing:' END,
        CASE WHEN NOT noref AND NOT noraw AND NOT notext AND bad THEN 'evidence.text_not_utf8:' END,
        CASE WHEN loaded AND source = 'src2' THEN 'evidence.text_hash_mismatch:/text_sha256' END,
        CASE WHEN loaded AND source = 'src3' THEN 'evidence.text_hash_mismatch:/text_sha256' END,
        CASE WHEN loaded AND ((lang = 'es' AND n_chars > 2500) OR (lang = 'fr' AND length(line) > 496)) THEN 'evidence.quote_too_long:/quote' END,
        CASE WHEN loaded AND q = '' THEN 'evidence.quote_empty:/quote' END,
        CASE WHEN loaded AND q <> '' AND lang = 'es' AND n_chars >= 1500 THEN 'evidence.page_out_of_range:/locator/pdf_page' END,
        CASE WHEN loaded AND q <> '' AND lang = 'es' AND n_chars < 1500 THEN 'evidence.paragraph_out_of_range:/locator/paragraph_index' END,
        CASE WHEN loaded AND lang = 'de' THEN 'evidence.quote_wrong_scope:/quote' END,
        CASE WHEN loaded AND lang = 'fr' THEN 'evidence.quote_not_found:/quote' END,
        CASE WHEN loaded AND q <> '' AND lang = 'en' AND n_chars <= 500 THEN 'evidence.offsets_mismatch:/locator' END,
        CASE WHEN loaded AND q <> '' AND lang = 'en' AND n_chars > 900 THEN 'evidence.heading_mismatch:/locator/heading' END], lambda x: x IS NOT NULL)) AS c FROM t)
    SELECT CAST(doc_id AS VARCHAR) AS record_id, '/evidence/0' || string_split(c, ':')[2] AS path, string_split(c, ':')[1] AS code, 'error' AS severity FROM f""")
def evidence_verification(spark, sf_dir):
    return quotes.findings(*snapshots(spark, sf_dir))
