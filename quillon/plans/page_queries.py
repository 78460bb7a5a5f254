"""Pages: blocks and links, sections and detail pages as records, directory tables.

The given pages have neither tables nor headings below the first level; pages with these are composed from the star's tables, so
that their number and what stands in them follow the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, sections
from .tables import query, read

#: The given pages' blocks in SQL: furniture is cut out, breaking tags part the rest, other tags are dropped.
PAGE_BLOCKS = r"""a AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<title\b.*?</title>', '', 'g'), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(h, '(?i)<h([1-6])[^>]*>', chr(2) || chr(1) || '\1', 'g'), '(?i)</h[1-6]>', chr(2), 'g'), '(?i)</?(p|div|article|br|body|html|head|meta|ul|section)\b[^>]*>|' || chr(2)) AS parts FROM a),
    c AS (SELECT page_id, url, unnest(parts) AS t, unnest(range(len(parts))) AS i FROM b),
    d AS (SELECT page_id, url, i, CASE WHEN t LIKE chr(1) || '%' THEN CAST(t[2] AS INTEGER) ELSE 0 END AS level, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '^' || chr(1) || '.', ''), '</?[a-zA-Z][^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM c),
    blocks AS (SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, CASE WHEN level > 0 THEN 'heading' ELSE 'paragraph' END AS kind, text, level FROM d WHERE text <> '')"""

FACTS = r"""regexp_matches(text, '(?i)\b(deadline|due|closes?|closing|apply by|no later than|submitted by|submit by)\b')"""
TOLD = r"""regexp_matches(text, '(?i)\b(eligib|must\b|required?\b|requirements?\b|open to|applicants?\b|enrolled|citizens?\b|member of|residents?\b|self-identif|minimum|gpa|average of|indigenous|first nations|m[ée]tis|inuit)')"""
FIRST_SENTENCE = r"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(left({t}, {n} - 1)) || '…' END"
SENTENCE = r"string_split_regex(trim({0}), '[.!?]\s+')[1] || CASE WHEN regexp_matches(trim({0}), '[.!?]\s') THEN regexp_extract(trim({0}), '([.!?])\s', 1) ELSE '' END"


def first_sentence(text: str, most: int = 240) -> str:
    return FIRST_SENTENCE.format(t="(" + SENTENCE.format(text) + ")", n=most)


@query(f"WITH {PAGE_BLOCKS} SELECT page_id, pos, kind, text, level FROM blocks")
def html_blocks(spark, sf_dir):
    return documents.blocks(read(spark, sf_dir, "pages"), "page_id", "html", "url")


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages),
    p AS (SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_extract(a, '"([^"]*)"', 1) AS href, trim(regexp_replace(replace(replace(replace(regexp_extract(a, '>([^<]*)<', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM l)
    SELECT page_id, href, text, '' AS heading FROM p""")
def html_links(spark, sf_dir):
    return documents.links(read(spark, sf_dir, "pages"), "page_id", "html", "url")


@query(f"""WITH {PAGE_BLOCKS}, r AS (SELECT page_id, url, min_by(text, pos) FILTER (WHERE level = 1) AS title, min_by(text, pos) FILTER (WHERE level = 0) AS body, count(*) FILTER (WHERE level = 0) AS n, count(*) FILTER (WHERE level = 0 AND NOT {FACTS} AND {TOLD}) AS t FROM blocks GROUP BY page_id, url)
    SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(regexp_extract(url, '([^/]*)/*$', 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 80), ''), 'item') AS native_key, title, {first_sentence("body")} AS summary, n AS n_paragraphs, least(t, 8) AS n_unstructured
    FROM r WHERE title IS NOT NULL AND n > 0""")
def detail_page_records(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    blocks = documents.blocks(pages, "page_id", "html", "url").join(pages.select("page_id", "url"), "page_id")
    r = sections.detail_records(blocks, "page_id", "url")
    return r.select("page_id", "native_key", "title", "summary", F.size("body").cast("long").alias("n_paragraphs"), F.size("unstructured").cast("long").alias("n_unstructured"))


def award_pages(spark, sf_dir):
    """A page for each customer: a heading for each order, its level by the status, its lines as paragraphs."""
    o, l, c = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    day = F.date_format("l_shipdate", "MMMM d, yyyy")
    says = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Applicants must hold part "), F.col("l_partkey"), F.lit(". More follows.")))
            .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.concat(F.lit("The deadline is "), day, F.lit(".")))
            .when(F.col("l_returnflag") == "A", F.concat(F.lit("Funded by Supplier "), F.col("l_suppkey"), F.lit(".")))
            .otherwise(F.concat(F.lit("Quantity "), F.col("l_quantity").cast("long"), F.lit(" shipped."))))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", says.alias("says"))
    lines = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit("<p>"), x.says, F.lit("</p>"))), "").alias("html"))
    level = F.when(F.col("o_orderstatus") == "F", "2").when(F.col("o_orderstatus") == "O", "3").otherwise("4")
    heading = F.when(F.col("o_orderpriority") == "5-LOW", "Related").when(F.year("o_orderdate") < 1995, F.concat("o_orderpriority", F.lit(" (award no. "), F.col("o_orderkey") + 1000, F.lit(")"))).otherwise(F.col("o_orderpriority"))
    part = F.concat(F.lit("<h"), level, F.lit(">"), heading, F.lit("</h"), level, F.lit(">"), F.coalesce("html", F.lit("")))
    body = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", part.alias("html")))), lambda x: x.html), "").alias("body"))
    return c.join(body, "c_custkey").select("c_custkey", F.concat(F.lit("<html><nav><a href='/'>Home</a></nav><main><h1>"), "c_name", F.lit("</h1><p>Awards of this office.</p>"), "body", F.lit("</main></html>")).alias("html"), F.concat(F.lit("https://office.example.org/"), F.col("c_custkey")).alias("url"))


#: The same blocks, sections and records from the tables.
AWARDS = r"""h AS (SELECT o.*, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END AS level, o_orderpriority = '5-LOW' AS skip FROM orders o JOIN customer ON c_custkey = o_custkey),
    k AS (SELECT o_custkey, count(*) FILTER (WHERE level = 2 AND NOT skip) AS n2, count(*) FILTER (WHERE level = 3 AND NOT skip) AS n3 FROM h GROUP BY o_custkey),
    v AS (SELECT o_custkey, CASE WHEN n2 + n3 = 0 THEN NULL WHEN n3 >= n2 THEN 3 ELSE 2 END AS chosen FROM k),
    s AS (SELECT h.*, chosen, 1 + sum(CASE WHEN level <= chosen THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS section FROM h JOIN v USING (o_custkey)),
    t AS (SELECT o_custkey, section, CASE WHEN year(o_orderdate) < 1995 THEN CAST(o_orderkey + 1000 AS VARCHAR) END AS number, o_orderpriority AS title FROM s WHERE level = chosen AND NOT skip),
    l AS (SELECT s.o_custkey, s.section, row_number() OVER (PARTITION BY s.o_custkey, s.section ORDER BY s.o_orderdate, s.o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_returnflag, l_linestatus, l_shipdate, l_suppkey, l_partkey, l_quantity FROM s JOIN lineitem ON l_orderkey = o_orderkey)"""


@query(rf"""WITH {AWARDS},
    g AS (SELECT o_custkey, section, count(*) AS n_paragraphs, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS n_deadlines, strftime(min_by(l_shipdate, n) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F'), '%Y-%m-%d') AS first_deadline,
        least(8, count(*) FILTER (WHERE l_returnflag = 'R')) AS n_unstructured, 'Supplier ' || max_by(l_suppkey, n) FILTER (WHERE l_returnflag = 'A' AND l_linestatus <> 'F') AS donor,
        min_by(CASE WHEN l_returnflag = 'R' THEN 'Applicants must hold part ' || l_partkey || '.' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'The deadline is ' || strftime(l_shipdate, '%B %-d, %Y') || '.' WHEN l_returnflag = 'A' THEN 'Funded by Supplier ' || l_suppkey || '.' ELSE 'Quantity ' || CAST(l_quantity AS BIGINT) || ' shipped.' END, n) AS summary FROM l GROUP BY o_custkey, section),
    r AS (SELECT t.o_custkey AS c_custkey, section, title, coalesce(number, replace(replace(lower(title), '-', '_'), ' ', '_')) AS native, g.* EXCLUDE (o_custkey, section) FROM t JOIN g USING (o_custkey, section)),
    q AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, native ORDER BY section) AS turn FROM r)
    SELECT c_custkey, CAST(section AS BIGINT) AS section, CASE WHEN turn > 1 THEN native || '-' || turn ELSE native END AS native_key, title, summary, donor, n_paragraphs, n_deadlines, first_deadline, n_unstructured FROM q""")
def sectioned_records(spark, sf_dir):
    marked = sections.sections(documents.blocks(award_pages(spark, sf_dir), "c_custkey", "html", "url"), "c_custkey")
    r = sections.section_records(marked, "c_custkey")
    size = lambda c: F.size(c).cast("long")
    return r.select("c_custkey", "section", "native_key", "title", "summary", "donor", size("body").alias("n_paragraphs"), size("deadlines").alias("n_deadlines"), F.get("deadlines", F.lit(0))["date"].cast("string").alias("first_deadline"), size("unstructured").alias("n_unstructured"))


@query(rf"""WITH {AWARDS} SELECT t.o_custkey AS c_custkey, CASE WHEN number IS NULL THEN title ELSE title || ' (award no. ' || number || ')' END AS item, 'heading without body text' AS reason FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.o_custkey = t.o_custkey AND l.section = t.section)
    UNION ALL SELECT o_custkey, NULL, 'no headings of the expected level' FROM v WHERE chosen IS NULL""")
def sectioned_pending(spark, sf_dir):
    marked = sections.sections(documents.blocks(award_pages(spark, sf_dir), "c_custkey", "html", "url"), "c_custkey")
    return sections.section_pending(marked, "c_custkey")


#: Customers on a directory page.
ON_A_PAGE = 40


def directory_pages(spark, sf_dir):
    """A table of customers on each page: some lead to a page of their own, some cells are empty, one segment's rows lack a column."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    rich, cell = F.col("c_acctbal") >= 0, lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    name = F.when(rich, F.concat(F.lit("<a href='http://dir.example.org/eng/"), F.col("c_custkey"), F.lit("'> "), "c_name", F.lit("</a>"))).otherwise(F.col("c_name"))
    last = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(cell(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("")))
    row = F.concat(F.lit("<tr>"), cell(name), cell(F.when(rich, F.col("n_name")).otherwise("")), cell(F.concat(F.lit("Office <b>"), "c_mktsegment", F.lit("</b> &amp; Sons"))), cell(F.lit("")), last, F.lit("</tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("html")))), lambda x: x.html), "\n")
    made = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.floor(F.col("c_custkey") / ON_A_PAGE).alias("page")).agg(rows.alias("rows"), F.count("*").alias("n"), F.max("c_acctbal").alias("top"))
    head = F.lit("<html><body><script>There are 7 bursaries</script><table><tr><th>Other</th></tr><tr><td>x</td></tr></table><table><tr><th>Name</th><th>Province or territory</th><th>Institution</th><th>Field</th><th>Group</th></tr>")
    more = F.when(F.col("top") > 9900, "<a href='?page=2'>Next</a> Update in progress").otherwise("<a href='/about'>About</a>")
    return made.select("page", F.concat(F.lit("<p>There are "), F.format_number("n", 0), F.lit(" bursaries.</p>"), head, "rows", F.lit("</table>"), more).alias("html"), F.concat(F.lit("https://dir.example.org/index?p="), F.col("page")).alias("url"))


DIRECTORY = f"""c AS (SELECT customer.*, n_name, c_custkey // {ON_A_PAGE} AS page, row_number() OVER (PARTITION BY c_custkey // {ON_A_PAGE} ORDER BY c_custkey) AS i FROM customer JOIN nation ON n_nationkey = c_nationkey),
    e AS (SELECT page, CASE WHEN c_acctbal >= 0 THEN 'http://dir.example.org/eng/' || c_custkey END AS detail_url, c_name AS name, CASE WHEN c_acctbal >= 0 THEN n_name ELSE '' END AS province, 'Office ' || c_mktsegment || ' & Sons' AS institution, '' AS field_of_study,
        CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE '' END AS indigenous_group, CAST(i AS INTEGER) AS row_ordinal FROM c WHERE c_mktsegment <> 'MACHINERY')"""


@query(f"""WITH {DIRECTORY} SELECT page, coalesce(detail_url, 'row-' || left(sha1(concat_ws('|', name, province, institution, field_of_study, indigenous_group, row_ordinal)), 16)) AS entry_id, name, province, institution, field_of_study, indigenous_group, detail_url, row_ordinal, 'discovery_only_not_verified' AS status FROM e""")
def directory_entries(spark, sf_dir):
    return sections.directory_entries(sections.directory_parts(directory_pages(spark, sf_dir), "page", "html", "url"), "page")


@query(f"""WITH {DIRECTORY}, p AS (SELECT page, count(*) AS declared_count, max(c_acctbal) > 9900 AS more, count(*) FILTER (WHERE c_mktsegment <> 'MACHINERY') AS entries_observed FROM c GROUP BY page)
    SELECT page, declared_count, entries_observed, round(entries_observed / declared_count, 4) AS coverage, CAST(CASE WHEN more THEN 1 ELSE 0 END AS BIGINT) AS pagination_links, entries_observed > 0 AND NOT more AND declared_count = entries_observed AS pagination_complete, more AS update_notice FROM p""")
def directory_coverage(spark, sf_dir):
    return sections.directory_coverage(sections.directory_parts(directory_pages(spark, sf_dir), "page", "html", "url"), "page")


@query(f"""WITH {DIRECTORY}, l AS (SELECT page, c_custkey, c_name FROM c WHERE c_acctbal >= 0)
    SELECT l.page, 'https://dir.example.org/eng/' || l.c_custkey AS url, nullif(max(e.indigenous_group), '') AS "group" FROM l LEFT JOIN e ON e.detail_url = 'http://dir.example.org/eng/' || l.c_custkey GROUP BY ALL""")
def directory_details(spark, sf_dir):
    parts = sections.directory_parts(directory_pages(spark, sf_dir), "page", "html", "url")
    visits = sections.directory_links(parts, "page").select("page", "url")
    return sections.with_groups(visits, sections.directory_entries(parts, "page"), "url").select("page", "url", "group")


#: All paragraphs of the customers' pages, with the heading of their order.
PARAGRAPHS = """p AS (SELECT o_custkey AS c_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'Related' WHEN year(o_orderdate) < 1995 THEN o_orderpriority || ' (award no. ' || (o_orderkey + 1000) || ')' ELSE o_orderpriority END AS heading,
        l_returnflag, l_linestatus, l_shipdate, l_partkey, l_suppkey, l_quantity, l_linenumber, l_extendedprice, l_orderkey FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey),
    b AS (SELECT *, 2 + dense_rank() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) + count(l_orderkey) OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS pos,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'The deadline is ' || strftime(l_shipdate, '%B %-d, %Y') || '.' END AS due FROM p)"""


@query(rf"""WITH {PARAGRAPHS} SELECT c_custkey, CAST(pos AS INTEGER) AS paragraph_index, heading, due AS quote, strftime(l_shipdate, '%Y-%m-%d') AS dates, 0 AS n_figures FROM b WHERE due IS NOT NULL""")
def policy_facts(spark, sf_dir):
    facts = sections.policy_facts(documents.blocks(award_pages(spark, sf_dir), "c_custkey", "html", "url"), "c_custkey")
    return facts.select("c_custkey", "paragraph_index", "heading", "quote", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"), F.size("figures").alias("n_figures"))


@query(rf"""WITH {PARAGRAPHS} SELECT c_custkey, count(due) AS deadline_words, count(due) AS dated, count(due) AS dated_deadlines, CAST(0 AS BIGINT) AS figures, count(*) FILTER (WHERE l_returnflag = 'R') AS conditions, count(due) > 0 AS promising FROM b GROUP BY c_custkey""")
def page_triage(spark, sf_dir):
    return sections.page_triage(documents.blocks(award_pages(spark, sf_dir), "c_custkey", "html", "url"), "c_custkey")
