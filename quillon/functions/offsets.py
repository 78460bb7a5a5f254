"""Canonical text with a map back: for each of its characters the place in the raw text that it came from."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import DASHES, PLAIN_QUOTES, QUOTES, ZERO_WIDTH

_PLAIN = str.maketrans(QUOTES + DASHES, PLAIN_QUOTES + "-" * len(DASHES))
_GONE = frozenset(ZERO_WIDTH[1:-1])


def _runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, composed form) of runs that compose on their own: a character and the marks and vowels that join it."""
    if text.isascii():
        return [(i, i + 1, c) for i, c in enumerate(text)]
    out, start = [], 0
    for i in range(1, len(text) + 1):
        if i < len(text) and (unicodedata.combining(text[i]) or not unicodedata.is_normalized("NFKC", "가" + text[i]) or 0x1160 <= ord(text[i]) <= 0x11FF):
            # Not surely a new start: it is one only where composing the parts alone gives what composing them together gives.
            if unicodedata.normalize("NFKC", text[start : i + 1]) != unicodedata.normalize("NFKC", text[start:i]) + unicodedata.normalize("NFKC", text[i]):
                continue
        out.append((start, i, unicodedata.normalize("NFKC", text[start:i])))
        start = i
    whole = unicodedata.normalize("NFKC", text)
    return out if "".join(r[2] for r in out) == whole else [(0, len(text), whole)]


def mapped(text: str) -> tuple[str, list[int], list[int]]:
    """The canonical text, and of each of its characters where it begins and ends in the raw one."""
    chars, starts, ends = [], [], []
    for a, b, made in _runs(text) if text else []:
        for c in made:
            if c in _GONE:
                continue
            if c.isspace():
                if chars and chars[-1] == " ":
                    ends[-1] = b
                elif chars:
                    chars.append(" "), starts.append(a), ends.append(b)
            else:
                chars.append(c.translate(_PLAIN)), starts.append(a), ends.append(b)
    if chars and chars[-1] == " ":
        chars.pop(), starts.pop(), ends.pop()
    return "".join(chars), starts, ends


BLOCK = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("paragraph_index", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("raw_start", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


def _blocks(text: str) -> list[tuple]:
    out, at = [], 0
    for number, page in enumerate(text.split("\f"), 1):
        heading, inner = None, at
        for i, block in enumerate(page.split("\n\n")):
            if block.startswith("#"):
                heading = block.lstrip("#").strip()
            out.append((number, i, heading, inner, *mapped(block)))
            inner += len(block) + 2
        at += len(page) + 1
    return out


#: Characters of texts whose blocks are held at once.
AT_ONCE = 1 << 17


@F.pandas_udf(T.ArrayType(BLOCK))
def blocks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text's blocks (parted by blank lines; pages by form feeds), each with its heading, its place in the raw text, and its canonical text with the map back into the block. A few texts at a time, as a map is many times its text."""
    for s in texts:
        whole = s.str.len().fillna(0).cumsum() // AT_ONCE if len(s) else s
        for _, part in s.groupby(whole.to_numpy(), sort=False):
            yield part.map(_blocks, na_action="ignore").astype(object)
