"""Fuzzy line deduplication by MinHash.

Signatures of character shingles, banding for a high recall, exact Jaccard verification, then distributed union-find: of
each component of similar lines one line stays, the one that comes first (least doc_id, then least line number).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, mix, utf8_bytes
from .minhash import tuned
from .scratch import Scratch, stored
from .spans import Spans, found, long_hashes, similar

#: Characters of a shingle. It says what a near copy is, so it is not for tuning the cost.
SHINGLE = 5
#: The least similarity in percent, and bands and rows for a recall of 99.9 % there.
PERCENT = 80
BANDS = tuned(PERCENT / 100, 0.999, 144)


def split_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z lower-cased), and start, end, row and number in its row of each line that holds a character other than white space."""
    raw, offsets = utf8_bytes(texts)
    data = raw + ((raw - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)  # A-Z
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(offsets[row + 1], np.append(starts[1:], len(data)))
    ends = ends - ((ends > starts) & (data[ends - 1] == 10)) if len(data) else ends
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    number = np.arange(len(starts)) - first[row] if len(starts) else np.empty(0, np.int64)
    solid = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data != 32) & ((data - np.uint8(9)) >= 5), out=solid[1:])
    some = solid[ends] > solid[starts]
    return data, starts[some], ends[some], row[some], number[some]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the first byte of each."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.uint32)
    long = np.flatnonzero(code >= 0xC0)
    bytes_ = np.append(at, len(data))[long + 1] - at[long]
    for size, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        those = long[(bytes_ == size) & (code[long] >= (0xC0, 0xE0, 0xF0)[size - 2]) & (code[long] < (0xE0, 0xF0, 0x100)[size - 2])]
        x = code[those] & mask
        for k in range(1, size):
            x = x << 6 | (data[at[those] + k] & 0x3F)
        code[those] = x
    return code, at


def char_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each span's shingles of SHINGLE characters, with repetitions, and each span's first; a shorter span is one shingle."""
    code, at = code_points(data)
    a, b = (at.searchsorted(x) if len(code) < len(data) else x for x in (starts, ends))
    n = np.maximum(b - a - SHINGLE + 1, 1)
    rows = np.concatenate([[0], np.cumsum(n)])
    # Five characters of Latin-1 are a number of 40 bits.
    small = np.concatenate([code.astype(np.uint8), np.zeros(8, np.uint8)])
    every = np.ndarray((len(code) + 1,), "<u8", small, strides=(1,))
    if (np.diff(a) >= n[:-1]).all():  # in order, as spans of lines are
        edge = np.zeros(len(code) + 2, np.int8)
        np.add.at(edge, a, 1)
        np.add.at(edge, a + n, -1)
        out = every[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    else:
        out = every[np.repeat(a - rows[:-1], n) + np.arange(rows[-1])]
    short = np.flatnonzero(b - a < SHINGLE)
    out[rows[short]] &= ~U64(0) >> (U64(64) - U64(8) * np.maximum(b[short] - a[short], 1).astype(U64))
    out &= U64((1 << 8 * SHINGLE) - 1)
    if len(code) and code.max() > 0xFF:
        first = np.repeat(a - rows[:-1], n) + np.arange(rows[-1])
        wide = np.concatenate([[0], np.cumsum(code > 0xFF)])
        last = np.minimum(first + SHINGLE, np.repeat(b, n))
        those = np.flatnonzero(wide[last] > wide[first])
        c = np.concatenate([code, np.zeros(SHINGLE, np.uint32)])
        v, w, x, y, z = (np.where(first[those] + k < last[those], c[first[those] + k].astype(U64), U64(0)) for k in range(SHINGLE))
        out[those] = mix((v | w << U64(21) | x << U64(42)) ^ mix(y | z << U64(21)))
    out *= U64(0x9E3779B97F4A7C15)
    return out, rows


def lines(texts: pa.Array) -> Spans:
    data, starts, ends, row, number = split_lines(texts)
    return Spans(row, number, ends - starts, *long_hashes(data, starts, ends), data, starts, ends, lambda some: char_shingles(data, starts[some], ends[some]))


def deduplicated(docs: DataFrame, percent: int = PERCENT, shape: tuple[int, int] = BANDS) -> DataFrame:
    """One row for each doc_id of docs (doc_id, text): doc_id, n_lines, n_removed, removed_lines (their numbers from 0, ascending).

    Lines are split at ``\\n``; those without a character other than white space are not counted and never removed. Lines
    are compared with A-Z lower-cased; equal ones are one node. Null and empty texts have no lines. Rows that share a
    doc_id are one document: lines of the same number share a verdict. Rows without a doc_id are left out. Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select("doc_id", "text").where("doc_id is not null")
    spans = scratch.stored(found(read, lines).withColumnRenamed("place", "line"))
    joined = similar(read, spans.withColumnRenamed("line", "place"), lines, lines, percent, shape, scratch)
    at = F.struct("doc_id", "line")
    distinct = spans.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("n")).withColumn("node", F.col("h1"))
    # Lines that are alone need no look-up: only nodes of larger components, and lines that occur again.
    grouped = scratch.stored(distinct.join(joined, "node", "left").where("n > 1 or comp is not null").select("h1", "h2", "at", "n", F.coalesce("comp", "h1").alias("comp"), F.when(F.col("comp").isNull(), F.col("h2")).otherwise(0).alias("comp2")))
    several = grouped.groupBy("comp", "comp2").agg(F.min("at").alias("keep"), F.sum("n").alias("lines")).where("lines > 1")
    keep = scratch.stored(grouped.join(several, ["comp", "comp2"]).select("h1", "h2", "keep"))
    removed = spans.join(keep, ["h1", "h2"]).where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line"))).select("doc_id", "line").distinct()
    by_doc = removed.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    counts = spans.groupBy("doc_id").agg(F.count_distinct("line").alias("n_lines"))
    every = docs.select("doc_id").where("doc_id is not null").distinct().join(counts, "doc_id", "left").join(by_doc, "doc_id", "left")
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    out = stored(every.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines")))
    scratch.clear()
    return out
