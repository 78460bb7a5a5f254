"""Text columns: folding for search, canonical text, ids, sentences."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bases() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xDF, 0x250)]
    pairs = [(x, d[0]) for x, d in pairs if x == x.lower() and len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(x for x, _ in pairs), "".join(b for _, b in pairs)


MARKED, BASE = _bases()
#: Quotation marks and dashes of canonical text.
QUOTES, DASHES = "‘’‚‛“”„‟", "‐‑‒–—―−"
PLAIN_QUOTES = "''''" + '""""'
ZERO_WIDTH = "[​‌‍⁠﻿­]"


def fold(text: Column) -> Column:
    """Lower case without accents, natively: Latin letters only. For any script see fold_exact."""
    return F.translate(F.lower(text), MARKED, BASE)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _base(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x).casefold() if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold(), na_action="ignore")


def fold_exact(text: Column) -> Column:
    """Decomposed, case-folded, without combining marks; every script."""
    return _fold_nfd(text)


def collapse(text: Column) -> Column:
    """Each run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def composed(text: Column) -> Column:
    """Compatibility-composed. ASCII is so already and stays out of Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def canonical(text: Column) -> Column:
    """Compatibility-composed, without zero-width characters, with plain quotes and dashes and single spaces; case is kept."""
    return plain_form(composed(text))


def plain_form(text: Column) -> Column:
    """Composed text in its canonical form."""
    plain = F.translate(F.regexp_replace(text, ZERO_WIDTH, ""), QUOTES + DASHES, PLAIN_QUOTES + "-" * len(DASHES))
    return collapse(plain)


_PLAIN = {ord(a): b for a, b in zip(QUOTES + DASHES, PLAIN_QUOTES + "-" * len(DASHES))} | dict.fromkeys(map(ord, ZERO_WIDTH[1:-1]))
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def canonical_text(text: str) -> str:
    """What ``canonical`` gives, for a text that is in Python already."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_PLAIN)
    elif text.isprintable() and "  " not in text:
        return text.strip(" ")
    return _SPACES.sub(" ", text).strip(" ")


def search_fold(text: Column) -> Column:
    """Canonical text, folded: the form in which listings are searched."""
    return _fold_nfkd(canonical(text))


def comparison(text: Column) -> Column:
    """ASCII letters and digits of the decomposed text in lower case, separated by single spaces: how two titles or names are compared."""
    return F.trim(F.regexp_replace(_base(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def contains_phrase(text: Column, phrase: str, folded=fold) -> Column:
    """Whether the folded text holds the folded phrase; a blank phrase is held by all."""
    return F.contains(folded(F.coalesce(text, F.lit(""))), F.trim(folded(F.lit(phrase))))


def contains_terms(text: Column, query: str, folded=fold) -> Column:
    """Whether the folded text holds every term of the query, in any order."""
    haystack = folded(F.coalesce(text, F.lit("")))
    return F.forall(F.filter(F.split(folded(F.lit(query)), r"\s+"), lambda t: t != ""), lambda t: F.contains(haystack, t))


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case ASCII letters and digits of the decomposed text joined by underscores, at most so many characters; ``item`` if none is left."""
    made = F.regexp_replace(F.regexp_replace(_ascii(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.regexp_replace(F.substring(made, 1, most), "_+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "item").otherwise(cut)


def record_id(namespace: Column, name: Column) -> Column:
    return F.concat_ws(":", slug(namespace, 40), slug(name, 140))


def is_record_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[a-z0-9_]+(:[a-z0-9_\-]+)+$"), F.lit(False))


def stable_id(raw: Column, most: int = 100) -> Column:
    """The id itself, or a prefix and a hash where it is too long."""
    return F.when(F.length(raw) <= most, raw).otherwise(F.concat(F.substring(raw, 1, most - 11), F.lit("-"), F.substring(F.sha1(raw), 1, 10)))


def first_sentence(text: Column, most: int = 240) -> Column:
    """Up to the first sentence's end, cut with an ellipsis where it is longer."""
    one = F.get(F.split(F.trim(text), r"(?<=[.!?])\s+", 2), 0)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…")))


def verbatim_prefix(text: Column, most: int = 300) -> Column:
    """The text's beginning, whole if short, else cut after its last full sentence or else word within the bound."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, r"^([\s\S]*[.!?])(?=\s)", 1)
    word = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).when(F.length(sentence) > 0, sentence).otherwise(word)


def excerpt(text: Column, most: int = 300) -> Column:
    return F.substring(text, 1, most)


def unsigned_hash31(text: Column) -> Column:
    """The 31-multiplier hash of code points, unsigned in 32 bits."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 31 + F.ascii(c)) % 4294967296))


def acronym(text: Column, most: int = 3) -> Column:
    """First letters of the words, upper case."""
    words = F.filter(F.split(F.trim(text), r"[\s\-/&,.()]+"), lambda w: ~F.lower(w).isin("", "the", "of", "and", "for"))
    return F.upper(F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.substring(w, 1, 1)), ""))


def sensitive(text: Column) -> Column:
    """Whether a text holds an e-mail address or names a document number."""
    return F.coalesce(text.rlike(r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}") | text.rlike(r"(?i)\b(status card|registry|passport|sin|card)\s*(number|no\.?|#)?\s*[:#]?\s*\d{5,}"), F.lit(False))


def formula_safe(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^\s*[=+@\-]"), F.concat(F.lit("'"), text)).otherwise(text)
