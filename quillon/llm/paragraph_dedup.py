"""Substring deduplication by paragraphs.

Paragraphs cover every word of a text: a line of LEAST to MOST words is one; runs of shorter lines are joined and longer
lines are cut, both at words that content alone chooses (the least hash within REACH words to either side). Paragraphs
meet by the bands of their MinHash signatures, tuned for a high recall, and are verified by exact Jaccard similarity of
their five-word shingles.

So that a passage is found where it begins and ends inside paragraphs, each text also has overlapping anchored ones, UNIT
words long, which begin at words that are chosen by their own hash (the least of each GAP words): a passage of
GAP + UNIT - 1 words or more holds a whole one wherever it stands, and the same one in every document. They meet by a
64-bit hash of all their words, and are extended word by word as far as their first document agrees.

A paragraph that only one document has is left alone. The first document (least doc_id) of each group of paragraphs keeps
it, the words of the others are for removal, so some document keeps every passage. Paragraphs that overlap or touch in a
document make one passage, and passages that share a paragraph are one cluster. Passages of less than LEAST words are left
to line deduplication.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import U64, Words, hash_spans, lists, mix, slices, table, windows, words_of
from .linking import components
from .minhash import tuned
from .ngram_join import SHINGLE
from .scratch import Scratch, met, small, stored
from .spans import Spans, found, similar

LEAST, MOST, REACH = 40, 160, 30
GAP, UNIT = 20, 30
PERCENT = 80
#: For a recall of 99.9 % at that similarity.
BANDS = tuned(PERCENT / 100, 0.999, 144)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` numbers in a row, by windows that double."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[: len(x) - done], x[done:]), 2 * done
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


#: Bits of a word's place that are packed with its hash; texts are worked on in slices, so places are small.
PLACE_BITS = 28


def anchored(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (in all words) and hash of each row's anchored paragraphs, every occurrence of them."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    if len(h) < GAP:
        return np.empty(0, np.int64), np.empty(0, U64)
    # Hashes with their places below: of equal words the first is the least.
    packed = mix(h) >> U64(PLACE_BITS) << U64(PLACE_BITS) | np.arange(len(h), dtype=U64)
    least = (least_of(packed, GAP) & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    least = least[row[: len(least)] == row[GAP - 1 :]]
    chosen = np.zeros(len(h), bool)
    chosen[least] = True
    at = np.flatnonzero(chosen)
    at = at[at + UNIT <= rows[row[at] + 1]]
    key = np.full(len(at), 9, U64)
    for k in range(UNIT):
        key = mix(key ^ h[at + k])
    return at, key


def line_words(w: Words) -> np.ndarray:
    """First word of each run of words in one line of one row (one more than runs)."""
    line = np.cumsum(w.data == 10)[w.starts] if len(w.starts) else np.empty(0, np.int64)
    row = w.row_of
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    return np.append(np.flatnonzero(new), len(line))


def paragraphs(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each paragraph; together they are all words."""
    runs = line_words(w)
    first, size = runs[:-1], np.diff(runs)
    if not len(first):
        return first, size
    row = w.row_of[first]
    alone = (size >= LEAST) & (size <= MOST)
    start = np.ones(len(first), bool)  # of a region: a line by itself, a longer one, or a run of short ones
    start[1:] = ~((size[1:] < LEAST) & (size[:-1] < LEAST) & (row[1:] == row[:-1]))
    region = first[start]
    end = np.append(region[1:], len(h))
    cuttable = np.repeat(~alone[start], end - region)
    x = mix(h ^ mix(np.append(h[1:], h[:1])))
    width = 2 * REACH + 1
    if len(x) < width:
        return region, end - region
    # The first of equal least hashes, so that a repeated word is no cut each time.
    middle = x[REACH : len(x) - REACH]
    at = np.flatnonzero((middle == least_of(x, width)) & (middle < least_of(x, REACH)[: len(middle)])) + REACH
    to_start = at - np.repeat(region, end - region)[at]
    to_end = np.repeat(end, end - region)[at] - at
    at = at[cuttable[at] & (to_start > REACH) & (to_end > REACH)]
    first = np.union1d(region, at)
    return first, np.diff(np.append(first, len(h)))


def of_words(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each run of words, with repetitions, and each run's first."""
    rows = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first - rows[:-1], size) + np.arange(rows[-1])
    return windows(h[at], rows, SHINGLE)


def spans_of(texts: pa.Array) -> Spans:
    """The paragraphs of SHINGLE words or more; their place is their first word."""
    w = words_of(texts, lower=True)
    h = hash_spans(w.data, w.starts, w.ends)
    first, size = paragraphs(w, h)
    first, size = first[size >= SHINGLE], size[size >= SHINGLE]
    shingles, rows = of_words(h, first, size)
    total = lambda x: np.add.reduceat(x, rows[:-1]) if len(first) else np.zeros(0, U64)
    row = w.row_of[first] if len(first) else first
    return Spans(row, first - w.rows[row], size, total(mix(shingles)), total(mix(shingles + U64(3))), w.data, w.starts[first], w.ends[first + size - 1] if len(first) else first, lambda some: of_words(h, first[some], size[some]))


def whole(texts: pa.Array) -> Spans:
    """Each text as one paragraph."""
    w = words_of(texts, lower=True)
    h = hash_spans(w.data, w.starts, w.ends)
    none = np.zeros(0, np.int64)
    return Spans(none, none, none, none, none, w.data, none, none, lambda some: of_words(h, w.rows[:-1][some], w.counts[some]))


DEALT = pa.schema([("part", pa.int32()), ("units", pa.binary())])
#: An anchored paragraph: its key, document and first word. A loose one was dealt out by itself; a lead stands for such ones at its key's place.
UNIT_KIND = np.dtype([("key", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("role", "u1")])
OWN, LOOSE, LEAD = 0, 1, 2
#: Anchored paragraphs that a task gathers, those of one key among them that go to its place, and those that a partition has on average.
GATHERED, TOGETHER, DEALT_TO = 1 << 19, 32, 1 << 20
SHARED = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("first", pa.int64()), ("at", pa.int32()), ("role", pa.int32())])
SHARED_DDL = "doc_id long, start int, key long, first long, at int, role int"


def _by_key(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units in order of key, document and place, and first and number of each key's."""
    x = x[np.lexsort((x["start"], x["doc"], x["key"]))]
    first = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]])) if len(x) else np.zeros(0, np.int64)
    return x, first, np.diff(np.append(first, len(x)))


def _units(batches, parts: int):
    """Anchored paragraphs by their key's partition, many in a row. Where a gathering has more than TOGETHER of a key, they are dealt out at random and only the first and the last go to the key's place besides."""
    held, size = [], 0

    def out():
        x, first, n = _by_key(np.concatenate(held))
        many = n > TOGETHER
        x["role"] = np.where(np.repeat(many, n), LOOSE, OWN)
        leads = x[np.concatenate([first[many], (first + n - 1)[many]])]
        leads["role"] = LEAD
        x = np.concatenate([x, leads])
        place = np.where(x["role"] == LOOSE, mix(x["doc"].view(U64) + x["start"].astype(U64)), x["key"].view(U64))
        part = (mix(place) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        here = np.flatnonzero(np.diff(cuts))
        return table({"part": here.astype(np.int32), "units": pa.array([x[order[cuts[p] : cuts[p + 1]]].tobytes() for p in here], pa.binary())}, DEALT)

    for batch in slices(batches):
        w = words_of(batch.column("text"), lower=True)
        at, key = anchored(hash_spans(w.data, w.starts, w.ends), w.rows)
        row = w.row_of[at] if len(at) else at
        x = np.zeros(len(at), UNIT_KIND)
        x["key"], x["doc"], x["start"] = key.view(np.int64), batch.column("doc_id").to_numpy()[row], at - w.rows[row]
        held.append(x)
        size += len(x)
        if size >= GATHERED:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _shared_units(batches):
    """Paragraphs whose key several documents have, with the key's first document and place; loose ones without these, and for them a row of each key that has leads."""
    read = [x for batch in batches for x in batch.column("units").to_pylist()]
    if not read:
        return
    x = np.frombuffer(b"".join(read), UNIT_KIND)
    del read

    def rows(x, first=None, role=OWN):
        for at in range(0, len(x), 1 << 17):
            y = x[at : at + (1 << 17)]
            z = None if first is None else first[at : at + (1 << 17)]
            yield table({"doc_id": y["doc"], "start": y["start"], "key": y["key"], "first": pa.nulls(len(y), pa.int64()) if z is None else pa.array(z["doc"]), "at": pa.nulls(len(y), pa.int32()) if z is None else pa.array(z["start"]), "role": np.full(len(y), role, np.int32)}, SHARED)

    yield from rows(x[x["role"] == LOOSE], role=LOOSE)
    x, first, n = _by_key(x[x["role"] != LOOSE])
    if not len(x):
        return
    several = x["doc"][first] != x["doc"][first + n - 1]
    lead = x[np.repeat(first, n)]
    mine = np.repeat(several, n) & (x["role"] == OWN)
    yield from rows(x[mine], lead[mine])
    keys = x[first[several & (np.maximum.reduceat(x["role"], first) == LEAD)]]
    yield from rows(keys, keys, LEAD)


CONTEXT = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])


def _context(batches):
    """The wanted anchored paragraphs with 32-bit hashes of up to GAP words before and after them, outwards."""
    for batch in slices(batches):
        w = words_of(batch.column("text"), lower=True)
        h = hash_spans(w.data, w.starts, w.ends)
        short = (h >> U64(32)).astype("<u4")
        at, key = anchored(h, w.rows)
        place = {x: k for k, x in enumerate(zip(*((w.row_of[at].tolist(), (at - w.rows[w.row_of[at]]).tolist()) if len(at) else ([], []))))}
        pick = np.array([place[i, s] for i, starts in enumerate(batch.column("wanted").to_pylist()) for s in starts if (i, s) in place], np.int64)
        at, key = at[pick], key[pick]
        row = w.row_of[at] if len(at) else at
        low, high = w.rows[row], w.rows[row + 1] if len(at) else at
        left = [short[max(a, x - GAP) : x][::-1].tobytes() for a, x in zip(low.tolist(), at.tolist())]
        right = [short[x + UNIT : min(b, x + UNIT + GAP)].tobytes() for b, x in zip(high.tolist(), at.tolist())]
        yield table({"doc_id": batch.column("doc_id").take(pa.array(row)), "start": (at - low).astype(np.int32), "key": key.view(np.int64), "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary())}, CONTEXT)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of up to GAP words of each row (rows x GAP), and how many there are."""
    texts = column.to_pylist()
    return np.frombuffer(b"".join(x.ljust(4 * GAP, b"\0") for x in texts), "<u4").reshape(len(texts), GAP), np.array([len(x) // 4 for x in texts], np.int64)


AGREED = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("last", pa.int32()), ("key", pa.int64()), ("first", pa.int64()), ("at", pa.int32()), ("l", pa.int32()), ("r", pa.int32())])


def _agreed(batches):
    """How many words before and after a run agree with those of the first document."""
    for batch in batches:
        out = []
        for side in ("left", "right"):
            (x, n), (y, m) = _words(batch.column(side)), _words(batch.column(f"keep_{side}"))
            same = (x == y) & (np.arange(GAP) < np.minimum(n, m)[:, None])
            out.append(np.logical_and.accumulate(same, 1).sum(1).astype(np.int32))
        yield table({**{c: batch.column(c) for c in ("doc_id", "start", "last", "key", "first", "at")}, "l": out[0], "r": out[1]}, AGREED)


def _exact(read: DataFrame, scratch: Scratch) -> DataFrame:
    """Intervals (doc_id, start, n, key, first) of the runs of anchored paragraphs that a document has in common with another one, the first that has them, extended as far as both agree; and those of the first one."""
    parts = max(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), (read.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 60 // DEALT_TO)
    found_ = scratch.stored(read.mapInArrow(lambda it: _units(it, parts), "part int, units binary").repartition(parts, "part").mapInArrow(_shared_units, SHARED_DDL))
    scratch.settle()
    keys = found_.where(F.col("role") == LEAD).select("key", "first", "at")
    loose = found_.where(F.col("role") == LOOSE).select("doc_id", "start", "key")
    loose = loose.join(F.broadcast(keys) if small(keys) else keys, "key").select("doc_id", "start", "key", "first", "at")
    shared = found_.where(F.col("role") == OWN).drop("role").union(loose)
    # Paragraphs of a run overlap or touch, and lie alike in both documents; the first one's own are left out.
    apart = (F.col("doc_id") != F.col("first")) | (F.col("start") != F.col("at"))
    along = Window.partitionBy("doc_id", "first", "offset").orderBy("start")
    new = F.coalesce(F.col("start") - F.lag("start").over(along) > UNIT, F.lit(True)).cast("int")
    run = shared.where(apart).distinct().withColumn("offset", F.col("start") - F.col("at")).withColumn("new", new).withColumn("run", F.sum("new").over(along))
    runs = scratch.stored(run.groupBy("doc_id", "first", "offset", "run").agg(F.min("start").alias("start"), F.max("start").alias("last"), F.min_by("key", "start").alias("key")).withColumns({"at": F.col("start") - F.col("offset"), "at_last": F.col("last") - F.col("offset")}).drop("offset", "run"))
    ends = [("doc_id", "start"), ("doc_id", "last"), ("first", "at"), ("first", "at_last")]
    asked = None
    for d, p in ends:
        one = runs.select(F.col(d).alias("doc_id"), F.col(p).alias("start"))
        asked = one if asked is None else asked.union(one)
    scratch.settle()
    wanted = scratch.stored(asked.distinct().groupBy("doc_id").agg(F.collect_list("start").alias("wanted")))
    holders = read.join(F.broadcast(wanted), "doc_id") if small(runs, 200_000) else met(read, wanted, "doc_id")
    context = scratch.stored(holders.mapInArrow(_context, "doc_id long, start int, key long, left binary, right binary").dropDuplicates(["doc_id", "start"]))
    both = runs
    for (d, p), side, name in zip(ends, ("left", "right", "left", "right"), ("left", "right", "keep_left", "keep_right")):
        both = both.join(context.select(F.col("doc_id").alias(d), F.col("start").alias(p), F.col(side).alias(name)), [d, p])
    agreed = scratch.stored(both.select("doc_id", "start", "last", "key", "first", "at", "left", "right", "keep_left", "keep_right").mapInArrow(_agreed, "doc_id long, start int, last int, key long, first long, at int, l int, r int"))
    size = F.col("last") - F.col("start") + UNIT + F.col("r")
    own = agreed.select("doc_id", (F.col("start") - F.col("l")).alias("start"), (size + F.col("l")).alias("n"), "key", "first")
    kept = agreed.groupBy("key", "first", "at").agg(F.max("l").alias("l"), F.max(size).alias("n"))
    return own.union(kept.select(F.col("first").alias("doc_id"), (F.col("at") - F.col("l")).alias("start"), (F.col("n") + F.col("l")).alias("n"), "key", "first"))


def repeated(docs: DataFrame, percent: int = PERCENT, shape: tuple[int, int] = BANDS) -> DataFrame:
    """One row for each passage that more than one document has: doc_id, start, n_words, cluster_id, n_removed.

    start and n_words count words of the whole text of docs (doc_id, text), A-Z lower-cased; cluster_id is the least
    doc_id of the passage's cluster, n_removed the number of its words that other documents keep. Null, empty and short
    texts, and texts that nothing else repeats, give no rows. Rows that share a doc_id are one document; rows without
    one are left out. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select("doc_id", "text").where("doc_id is not null")
    exact = scratch.stored(_exact(read, scratch))
    scratch.settle()
    spans = scratch.stored(found(read, spans_of))
    intervals = scratch.stored(exact.unionByName(_shared(_similar(read, spans, percent, shape, scratch))))
    out = stored(_passages(intervals, scratch))
    scratch.clear()
    return out


def _shared(intervals: DataFrame) -> DataFrame:
    """Intervals (doc_id, start, n, key) whose key several documents have, with the first of them."""
    keys = intervals.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    return intervals.join(keys, "key").select("doc_id", "start", "n", "key", "first")


def _similar(read: DataFrame, spans: DataFrame, percent: int, shape: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Paragraphs (doc_id, start, n) with the component of similar ones as their key; only those that another document's equals or resembles."""
    joined = similar(read, spans, spans_of, whole, percent, shape, scratch)
    distinct = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).withColumn("node", F.col("h1"))
    several = distinct.join(joined, "node", "left").where("lo < hi or comp is not null").select("h1", "h2", F.when(F.col("comp").isNull(), F.xxhash64("h1", "h2")).otherwise(F.xxhash64(F.lit("paragraph"), "comp")).alias("key"))
    return spans.join(several, ["h1", "h2"]).select("doc_id", F.col("place").alias("start"), F.col("size").alias("n"), "key")


def _passages(intervals: DataFrame, scratch: Scratch) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("start", "n", "key").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start", "n", "key").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.col("n")
    gone = F.when(F.col("doc_id") != F.col("first"), end)
    # Words of an interval that no earlier one has removed: intervals come by their start, so those reach to the furthest end.
    fresh = F.when(gone.isNotNull(), F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(gone).over(before), F.lit(0))), F.lit(0))).otherwise(0)
    marked = intervals.select("*", fresh.alias("fresh"), F.coalesce(F.col("start") > F.max(end).over(before), F.lit(True)).cast("int").alias("new")).withColumn("passage", F.sum("new").over(upto))
    marked = scratch.stored(marked.select("doc_id", "passage", "start", "n", "key", "fresh"))
    whole = scratch.stored(marked.groupBy("doc_id", "passage").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.sum("fresh").alias("n_removed")).where(F.col("end") - F.col("start") >= LEAST).withColumn("node", F.monotonically_increasing_id()))
    of_key = scratch.stored(marked.select("doc_id", "passage", "key").join(whole.select("doc_id", "passage", "node"), ["doc_id", "passage"]).select("key", "node").distinct())
    centre = of_key.groupBy("key").agg(F.min("node").alias("centre"))
    joined = components(of_key.join(centre, "key").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), scratch)
    named = whole.join(joined, "node")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("cluster_id"))
    return named.join(least, "comp").select("doc_id", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), "cluster_id", F.col("n_removed").cast("long").alias("n_removed"))
