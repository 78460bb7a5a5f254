"""Pages to records: one record for each section or detail page, and the rows of directory tables."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as texts
from ..functions import urls
from ..functions.dates import stated_dates
from ..functions.hashing import row_fingerprint
from .documents import whole_references

# Headings that start no record, cues of sentences, a number at a title's end, a sponsor's line, the directory's columns and phrases.
SKIPPED_HEADINGS = r"(?i)^(on this page|contents|table of contents|related|more information|share|menu|search|contact us|footer|navigation)$"
DEADLINE_CUE = r"(?i)\b(deadline|due|closes?|closing|apply by|no later than|submitted by|submit by)\b"
ELIGIBILITY_CUE = r"(?i)\b(eligib|must\b|required?\b|requirements?\b|open to|applicants?\b|enrolled|citizens?\b|member of|residents?\b|self-identif|minimum|gpa|average of|indigenous|first nations|m[ée]tis|inuit)"
NUMBER_AT_END = r"(?i)\s*[(\[#]\s*(?:award\s*)?(?:no\.?\s*)?(\d{3,7})\s*[)\]]?\s*$"
DONOR = r"(?i)^(?:donor|sponsored by|funded by|presented by|in memory of)\s*:?\s*(.{3,120})$"
DIRECTORY_COLUMNS = ("name", "province", "institution", "field_of_study", "indigenous_group")
DECLARED_COUNT = r"(?i)There (?:are|is)\s+([\d,]+)\s+bursar"
NEXT_PAGE = r"(?i)^(next|suivant|more|load more|page\s*\d+|›|»)$"
NOTICE = "update in progress"
#: Eligibility sentences that a record keeps.
SENTENCES = 8


def starts_record(level: Column, text: Column, levels: tuple[int, ...]) -> Column:
    return level.isin(*levels) & ~text.rlike(SKIPPED_HEADINGS)


def sections(blocks: DataFrame, key: str, levels: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Blocks (key, pos, kind, text, level; level 0: no heading) with the page's record level, a section number and the section's title.

    The record level is the one of ``levels`` that has most headings, the deeper of equals. A heading at that level or above ends
    the section before it; at that level it starts one, unless it is a furniture heading. title is null outside of sections, and
    level_of_records on pages without such headings. One shuffle by page serves all windows.
    """
    page, run = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = starts_record(F.col("level"), F.col("text"), levels)
    counted = [F.struct(F.count_if(starts & (F.col("level") == v)).over(page).alias("n"), F.lit(v).alias("level")) for v in levels]
    found = [F.when(c["n"] > 0, c) for c in counted]
    best = F.greatest(*found) if len(found) > 1 else found[0]
    marked = blocks.withColumn("level_of_records", best["level"])
    ends = (F.col("level") > 0) & (F.col("level") <= F.col("level_of_records"))
    opened = F.when(ends, F.struct(F.when(starts & (F.col("level") == F.col("level_of_records")), F.col("text")).alias("title")))
    return marked.withColumn("section", F.sum(F.when(ends, 1).otherwise(0)).over(run)).withColumn("title", F.last(opened, ignorenulls=True).over(run)["title"])


def _facts(body: Column) -> list[Column]:
    """What a record takes from its paragraphs (structs of pos, text), in their order."""
    dated = F.filter(body, lambda p: p.text.rlike(DEADLINE_CUE))
    deadlines = F.flatten(F.transform(dated, lambda p: F.transform(stated_dates(p.text), lambda d: F.struct(d.alias("date"), p.pos.alias("pos")))))
    told = F.slice(F.filter(body, lambda p: ~p.text.rlike(DEADLINE_CUE) & p.text.rlike(ELIGIBILITY_CUE)), 1, SENTENCES)
    donors = F.filter(body, lambda p: p.text.rlike(DONOR))
    last = F.get(donors, F.size(donors) - 1)["text"]
    return [
        texts.first_sentence(F.get(body, 0)["text"]).alias("summary"),
        F.when(F.size(donors) > 0, F.regexp_replace(F.trim(F.regexp_extract(last, DONOR, 1)), r"\.+$", "")).alias("donor"),
        deadlines.alias("deadlines"),
        F.transform(told, lambda p: F.struct(texts.first_sentence(p.text, 300).alias("text"), p.pos.alias("pos"))).alias("unstructured"),
    ]


def section_records(marked: DataFrame, key: str) -> DataFrame:
    """From ``sections``: one row for each section that has paragraphs: (key, section, native_key, title, body, summary, donor, deadlines, unstructured).

    native_key is the number at the heading's end, which the title then lacks, or else the title's slug; one that comes again
    on its page gets ``-n``.
    """
    paragraph = F.when((F.col("level") == 0) & (F.trim("text") != ""), F.struct("pos", "text"))
    made = marked.where("title is not null").groupBy(key, "section").agg(F.first("title").alias("heading"), F.array_sort(F.collect_list(paragraph)).alias("body")).where(F.size("body") > 0)
    number = F.regexp_extract("heading", NUMBER_AT_END, 1)
    title = F.when(number != "", F.trim(F.regexp_replace("heading", NUMBER_AT_END, ""))).otherwise(F.col("heading"))
    named = made.withColumn("title", title).withColumn("native", F.when(number != "", number).otherwise(texts.slug(F.col("title"))))
    turn = F.row_number().over(Window.partitionBy(key, "native").orderBy("section"))
    native = F.when(F.col("_turn") > 1, F.concat_ws("-", "native", F.col("_turn"))).otherwise(F.col("native"))
    return named.withColumn("_turn", turn).select(key, "section", native.alias("native_key"), "title", "body", *_facts(F.col("body")))


def section_pending(marked: DataFrame, key: str) -> DataFrame:
    """From ``sections``: (key, item, reason) of pages without record headings, and of headings without paragraphs; nothing is guessed for them."""
    pages = marked.groupBy(key).agg(F.max("level_of_records").alias("v")).where("v is null").select(key, F.lit(None).cast("string").alias("item"), F.lit("no headings of the expected level").alias("reason"))
    bare = marked.where("title is not null").groupBy(key, "section").agg(F.first("title").alias("item"), F.count_if((F.col("level") == 0) & (F.trim("text") != "")).alias("n")).where("n = 0")
    return pages.unionByName(bare.select(key, "item", F.lit("heading without body text").alias("reason")))


def detail_records(blocks: DataFrame, key: str, url: str, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One record for each page (blocks with its url) that has a title and paragraphs: (key, native_key, title, body, summary, donor, deadlines, unstructured); its key comes from the address's last part."""
    head = F.when(starts_record(F.col("level"), F.col("text"), levels), F.struct("pos", "text"))
    paragraph = F.when((F.col("level") == 0) & (F.trim("text") != ""), F.struct("pos", "text"))
    made = blocks.groupBy(key, url).agg(F.min(head)["text"].alias("title"), F.array_sort(F.collect_list(paragraph)).alias("body")).where((F.size("body") > 0) & F.col("title").isNotNull())
    tail = F.regexp_extract(F.regexp_replace(F.col(url), "/+$", ""), "([^/]*)$", 1)
    return made.select(key, texts.slug(F.when(tail == "", F.col("title")).otherwise(tail)).alias("native_key"), "title", "body", *_facts(F.col("body")))


class _Tables(HTMLParser):
    """Tables of a page: their headers and rows of cells, each cell with its first link; links and the text outside of scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.cell: dict | None = None
        self.links: list[dict] = []
        self.link: dict | None = None
        self.text: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.open.append({"headers": [], "rows": []})
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1]["rows"].append([])
        elif tag in ("td", "th") and self.open:
            self.cell = {"text": [], "href": None, "head": tag == "th"}
            if tag == "th":
                self.open[-1]["headers"].append(self.cell)
            elif self.open[-1]["rows"]:
                self.open[-1]["rows"][-1].append(self.cell)
        elif tag == "a" and own.get("href") is not None:
            self.link = {"href": own["href"], "rel": own.get("rel"), "text": []}
            self.links.append(self.link)
            if self.cell is not None and self.cell["href"] is None:
                self.cell["href"] = own["href"]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.open.pop()
            self.cell = None
        elif tag in ("td", "th"):
            self.cell = None
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        if self.cell is not None:
            self.cell["text"].append(data)
        if self.link is not None:
            self.link["text"].append(data)


def _plain(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


@udtf(returnType="part string, ordinal int, cells array<string>, href string, text string")
class DirectoryParts:
    """Rows (part = row) of the page's directory tables, empty cells kept; its links (part = link, text ``next`` in cells for a rel); its text (part = page)."""

    def eval(self, html: str, url: str):
        page = _Tables()
        page.feed(whole_references(html or ""))
        page.close()
        base = url or ""

        def absolute(href):
            try:
                return None if href is None else urljoin(base, href)
            except ValueError:
                return None

        for table in page.tables:
            headers = [_plain(h["text"]).lower() for h in table["headers"]]
            if not headers or not headers[0].startswith("name") or not any("province" in h for h in headers):
                continue
            for ordinal, cells in enumerate(table["rows"]):
                if cells:
                    yield "row", ordinal, [_plain(c["text"]) for c in cells], absolute(cells[0]["href"]), None
        for ordinal, link in enumerate(page.links):
            yield "link", ordinal, [link["rel"] or ""], absolute(link["href"]), _plain(link["text"])
        yield "page", 0, [], None, _plain(page.text)


def directory_parts(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, part, ordinal, cells, href, text), by a lateral join of each page with its parts."""
    return pages.select(key, html, url).lateralJoin(DirectoryParts(F.col(html).outer(), F.col(url).outer())).select(key, "part", "ordinal", "cells", "href", "text")


def directory_entries(parts: DataFrame, key: str) -> DataFrame:
    """Rows of the expected width: (key, entry_id, the five columns, detail_url, row_ordinal, status). An entry's id is its detail address, or a fingerprint of its cells and place."""
    own = parts.where((F.col("part") == "row") & (F.size("cells") == len(DIRECTORY_COLUMNS)))
    columns = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(DIRECTORY_COLUMNS)]
    detail = urls.canonical(F.col("href"))
    name = F.concat(F.lit("row-"), row_fingerprint(F.array_join("cells", "|"), F.col("ordinal")))
    return own.select(key, F.coalesce(detail, name).alias("entry_id"), *columns, detail.alias("detail_url"), F.col("ordinal").alias("row_ordinal"), F.lit("discovery_only_not_verified").alias("status"))


def directory_pending(parts: DataFrame, key: str) -> DataFrame:
    """Rows of another width, with the reason."""
    odd = parts.where((F.col("part") == "row") & (F.size("cells") != len(DIRECTORY_COLUMNS)))
    return odd.select(key, F.concat(F.lit("row "), F.col("ordinal")).alias("item"), F.concat(F.lit("unexpected column count "), F.size("cells")).alias("reason"))


def directory_coverage(parts: DataFrame, key: str) -> DataFrame:
    """A row for each page: declared and observed entries, coverage (rounded to 4 places), links to further pages, whether all was seen, and whether a notice says that the page is being updated."""
    declared = F.regexp_replace(F.regexp_extract("text", DECLARED_COUNT, 1), ",", "").try_cast("long")
    page, fits = F.col("part") == "page", (F.col("part") == "row") & (F.size("cells") == len(DIRECTORY_COLUMNS))
    further = (F.col("part") == "link") & (F.col("text").rlike(NEXT_PAGE) | (F.get("cells", F.lit(0)) == "next"))
    made = parts.groupBy(key).agg(F.max(F.when(page, declared)).alias("declared_count"), F.count_if(fits).alias("entries_observed"), F.count_if(further).alias("pagination_links"), F.max(F.when(page, F.contains(F.lower("text"), F.lit(NOTICE)))).alias("update_notice"))
    whole = (F.col("entries_observed") > 0) & (F.col("pagination_links") == 0) & F.coalesce(F.col("declared_count") == F.col("entries_observed"), F.lit(False))
    return made.withColumn("coverage", F.when(F.col("declared_count") > 0, F.round(F.col("entries_observed") / F.col("declared_count"), 4))).withColumn("pagination_complete", whole)


def directory_links(parts: DataFrame, key: str) -> DataFrame:
    """(key, url) of the links, in a page's order, whose text is the name in one of its rows: the detail pages to visit."""
    names = parts.where("part = 'row'").select(key, F.get("cells", F.lit(0)).alias("text")).where("text <> ''")
    own = parts.where("part = 'link'").select(key, "ordinal", "href", "text")
    return own.join(names, [key, "text"], "left_semi").select(key, urls.secure(F.col("href")).alias("url"), "ordinal")


def with_groups(details: DataFrame, entries: DataFrame, url: str) -> DataFrame:
    """Detail pages with the group that the directory names for their address (the last row's, empty ones as null); null where no row leads there."""
    named = entries.where("detail_url is not null").groupBy(urls.secure(F.col("detail_url")).alias("_to")).agg(F.max_by("indigenous_group", F.struct("row_ordinal", "indigenous_group")).alias("group"))
    return details.join(named, urls.secure(F.col(url)) == F.col("_to"), "left").drop("_to").withColumn("group", F.when(F.col("group") != "", F.col("group")))


# Cues of sentences about how to apply, and how much of one is kept.
POLICY_CUE = r"(?i)\b(deadline|one application|single application|apply once|shared|application form|documents?|transcript|intake|cycle|submit|eligib)\b"
POLICY_CHARS = 400


def policy_facts(blocks: DataFrame, key: str) -> DataFrame:
    """(key, paragraph_index, heading, quote, dates, figures) of each paragraph that speaks of how to apply: the nearest heading above it, its beginning in canonical text, and the dates and dollar figures that it states. What they mean for single records is left to people."""
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    headed = blocks.withColumn("heading", F.last(F.when(F.col("level") > 0, F.col("text")), ignorenulls=True).over(run))
    plain = texts.canonical(F.col("text"))
    figures = F.regexp_extract_all(plain, F.lit(r"(\$\s?\d[\d,]*(?:\.\d+)?)"), 1)
    return headed.where((F.col("level") == 0) & F.col("text").rlike(POLICY_CUE)).select(key, F.col("pos").alias("paragraph_index"), "heading", F.substring(plain, 1, POLICY_CHARS).alias("quote"), stated_dates(plain).alias("dates"), figures.alias("figures"))


def page_triage(blocks: DataFrame, key: str) -> DataFrame:
    """A row for each page: paragraphs with a deadline's words, with a stated date, with a dollar figure, and about who may apply; ``promising`` where a paragraph has both a deadline's words and a date, or where figures and conditions stand together on the page."""
    text, level = F.col("text"), F.col("level")
    cue, dated, money, told = text.rlike(DEADLINE_CUE), F.size(stated_dates(text)) > 0, text.rlike(r"\$\s?\d"), text.rlike(ELIGIBILITY_CUE)
    count = lambda c: F.count_if((level == 0) & c)
    made = blocks.groupBy(key).agg(count(cue).alias("deadline_words"), count(dated).alias("dated"), count(cue & dated).alias("dated_deadlines"), count(money).alias("figures"), count(told).alias("conditions"))
    return made.withColumn("promising", (F.col("dated_deadlines") > 0) | ((F.col("figures") > 0) & (F.col("conditions") > 0)))
