"""Quotes found in texts, with places in the raw text, and evidence verified against its snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import offsets
from ..functions.hashing import sha256
from ..functions.text import canonical, composed, plain_form
from .validation import exploded

#: The longest quote, and what parts blocks and pages.
MOST_CHARS = 500
BLOCK, PAGE = "\n\n", "\f"


def located(quotes: DataFrame, texts: DataFrame, document: str, text: str, quote: str = "quote") -> DataFrame:
    """Quotes (document, quote, and what else they have) with their first block: page, paragraph_index, heading, text_start and text_end in its canonical text, and raw_start and raw_end, which cut the same words out of the raw text; null where no block of the document holds the quote.

    Texts are shuffled once, by document; quotes meet the blocks of their own document only.
    """
    asked = quotes.withColumn("_q", canonical(F.col(quote))).withColumn("_id", F.monotonically_increasing_id())
    wanted = asked.where("_q <> ''").groupBy(document).agg(F.collect_list(F.struct("_id", "_q")).alias("_asked"))
    met = texts.select(document, text).join(wanted, document).select("_asked", F.explode(offsets.blocks(F.col(text))).alias("_b"))
    hit = F.transform(F.filter("_asked", lambda a: F.contains(F.col("_b.text"), a._q)), lambda a: F.struct(a._id.alias("_id"), (F.instr(F.col("_b.text"), a._q) - 1).alias("text_start"), F.length(a._q).alias("n")))
    at = F.col("_h.text_start")
    found = met.select("_b", F.explode(hit).alias("_h")).select(
        "_h._id", F.struct("_b.page", "_b.paragraph_index", "_b.heading", at.alias("text_start"), (at + F.col("_h.n")).alias("text_end"),
                           (F.col("_b.raw_start") + F.get("_b.starts", at)).alias("raw_start"), (F.col("_b.raw_start") + F.get("_b.ends", at + F.col("_h.n") - 1)).alias("raw_end")).alias("_at"))
    first = found.groupBy("_id").agg(F.min_by("_at", F.struct("_at.page", "_at.paragraph_index")).alias("_at"))
    return asked.join(first, "_id", "left").select(*(c for c in quotes.columns), "_at.*")


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def heading_of(blocks: Column, index: Column) -> Column:
    """The heading at or above a block: its text without the marks."""
    above = F.filter(F.slice(blocks, F.lit(1), F.greatest(index + 1, F.lit(0))), lambda b: b.startswith("#"))
    last = F.get(above, F.size(above) - 1)
    return F.trim(F.regexp_replace(last, "^#+", ""))


def findings(evidence: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (record_id, path, code, severity) of evidence that its snapshot doesn't bear out.

    evidence: record_id, at, snapshot_id, source_id, raw_sha256, text_sha256, quote, pdf_page, paragraph_index, text_start,
    text_end, heading; refs: record_id, snapshot_id, source_id, raw_sha256, text_sha256; files: snapshot_id, raw and text as
    binary, null where the file is missing. A finding that leaves nothing to look at (no reference, no text, an empty
    quote, no such page or paragraph, no such words) is the last of its item. One join by snapshot brings the texts.
    """
    ref = refs.select("record_id", "snapshot_id", F.struct("source_id", "raw_sha256", "text_sha256").alias("ref"))
    stored = files.select("snapshot_id", sha256("raw").alias("_raw"), sha256("text").alias("_text"), F.is_valid_utf8(F.col("text").cast("string")).alias("_utf8"), F.try_validate_utf8(F.col("text").cast("string")).alias("_body"))
    e = evidence.join(ref, ["record_id", "snapshot_id"], "left").join(stored, "snapshot_id", "left")
    e = e.withColumn("_q", canonical(F.coalesce("quote", F.lit("")))).withColumn("_pages", F.split("_body", PAGE))
    page = F.when(F.col("pdf_page").isNull(), F.col("_body")).when(F.col("pdf_page") >= 1, F.get("_pages", F.col("pdf_page") - 1))
    e = e.withColumn("_page", page).withColumn("_blocks", F.split("_page", BLOCK))
    scope = F.when(F.col("paragraph_index").isNull(), F.col("_page")).when(F.col("paragraph_index") >= 0, F.get("_blocks", F.col("paragraph_index")))
    # A text goes to Python once: what parts pages and blocks is neither made nor lost where characters are composed.
    own_page = F.when(F.col("pdf_page").isNull(), F.col("_composed")).when(F.col("pdf_page") >= 1, F.get(F.split("_composed", PAGE), F.col("pdf_page") - 1))
    own_scope = F.when(F.col("paragraph_index").isNull(), own_page).when(F.col("paragraph_index") >= 0, F.get(F.split(own_page, BLOCK), F.col("paragraph_index")))
    e = e.withColumn("_scope", scope).withColumn("_composed", composed(F.col("_body"))).withColumn("_plain", plain_form(own_scope)).withColumn("_whole", plain_form(F.replace("_composed", F.lit(PAGE), F.lit(" "))))
    held = F.contains("_plain", F.col("_q"))
    own = F.coalesce("paragraph_index", F.array_position(F.transform("_blocks", lambda b: F.contains(F.regexp_replace(b, r"(?U)\s+", " "), F.col("_q"))), True) - 1)
    own = F.when(own < 0, F.size("_blocks") - 1).otherwise(own).cast("int")
    e = e.withColumn("_heading", canonical(heading_of(F.col("_blocks"), own)))
    say = lambda when, code: F.when(F.coalesce(when, F.lit(False)), F.lit(code))
    differs = lambda field: ~F.col(f"_{field}").eqNullSafe(F.col(f"{field}_sha256"))
    ref_differs = lambda field: F.col(f"ref.{field}_sha256").isNotNull() & (F.col(f"ref.{field}_sha256") != F.col(f"_{field}"))
    loaded = F.col("_raw").isNotNull() & F.col("_text").isNotNull() & F.coalesce(F.col("_utf8"), F.lit(False))
    quoted = loaded & (F.col("_q") != "")
    paged = quoted & F.col("_page").isNotNull()
    placed = paged & F.col("_scope").isNotNull()
    right = placed & held
    offset = (F.col("text_start").isNotNull() | F.col("text_end").isNotNull()) & ~F.coalesce(cut(F.col("_plain"), F.col("text_start"), F.col("text_end")) == F.col("_q"), F.lit(False))
    none = F.col("ref").isNull()
    codes = [say(none, "evidence.snapshot_ref_missing:snapshot_id")] + [F.when(~none, c) for c in (
        say(~F.col("source_id").eqNullSafe(F.col("ref.source_id")), "evidence.source_mismatch:source_id"),
        say(F.col("_raw").isNull(), "evidence.raw_missing"),
        say(F.col("_text").isNull(), "evidence.text_missing"),
        say(F.col("_raw").isNotNull() & F.col("_text").isNotNull() & ~F.col("_utf8"), "evidence.text_not_utf8"),
        say(loaded & differs("raw"), "evidence.raw_hash_mismatch:raw_sha256"),
        say(loaded & ref_differs("raw"), "evidence.raw_hash_mismatch:raw_sha256"),
        say(loaded & differs("text"), "evidence.text_hash_mismatch:text_sha256"),
        say(loaded & ref_differs("text"), "evidence.text_hash_mismatch:text_sha256"),
        say(loaded & (F.length("quote") > MOST_CHARS), "evidence.quote_too_long:quote"),
        say(loaded & (F.col("_q") == ""), "evidence.quote_empty:quote"),
        say(quoted & F.col("_page").isNull(), "evidence.page_out_of_range:locator/pdf_page"),
        say(paged & F.col("_scope").isNull(), "evidence.paragraph_out_of_range:locator/paragraph_index"),
        say(placed & ~held & F.contains("_whole", F.col("_q")), "evidence.quote_wrong_scope:quote"),
        say(placed & ~held & ~F.contains("_whole", F.col("_q")), "evidence.quote_not_found:quote"),
        say(right & offset, "evidence.offsets_mismatch:locator"),
        say(right & F.col("heading").isNotNull() & ~F.col("_heading").eqNullSafe(canonical(F.col("heading"))), "evidence.heading_mismatch:locator/heading"),
    )]
    return exploded(e, F.col("record_id"), F.array_compact(F.array(*codes)), F.concat(F.lit("/evidence/"), F.col("at")))


def source_findings(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of source references (record_id, at, snapshot_id, raw_sha256, text_sha256) whose files are missing or of another hash."""
    stored = files.select("snapshot_id", sha256("raw").alias("_raw"), sha256("text").alias("_text"))
    e = refs.join(stored, "snapshot_id", "left")
    gone = F.col("_raw").isNull() | F.col("_text").isNull()
    codes = [F.when(F.col("_raw").isNull(), "evidence.raw_missing"), F.when(F.col("_text").isNull(), "evidence.text_missing")]
    codes += [F.when(~gone & ~F.col(f"{f}_sha256").eqNullSafe(F.col(f"_{f}")), f"source_ref.{f}_hash_mismatch:{f}_sha256") for f in ("raw", "text")]
    return exploded(e, F.col("record_id"), F.array_compact(F.array(*codes)), F.concat(F.lit("/source_refs/"), F.col("at")))
