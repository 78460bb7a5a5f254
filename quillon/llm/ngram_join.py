"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct shingles of five words, ordered from rare to frequent by hashed counts over
the whole corpus. Two sets that are similar share a token of their prefixes. Rare tokens are indexed singly; documents
whose prefix holds frequent ones, or rare ones with a long list, are joined among themselves by ``linking.prefix_join``:
there tokens are ordered by exact counts and frequent classes are indexed in combinations of two or three, with the
prefix extended for that. Candidates are verified exactly on their whole sets.

With t = 4/5: a set x of n tokens overlaps any partner by at least ceil(4n/5), so it probes with its first
n - ceil(4n/5) + 1 tokens; a partner y of m tokens that is no larger overlaps by at least ceil(8m/9).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, hash_spans, lists, mix, slices, table, windows, words_of
from .linking import TokenSets, components, connect, places_of, sketch
from .scratch import Scratch, only, small, stored

SHINGLE = 5
#: Hashed counts of shingles, over the whole corpus.
BUCKETS = 1 << 18
#: A shingle is frequent if its bucket holds so many times the mean, and what chance adds to that.
FREQUENT = 1.5


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's shingles in order, with repetitions, and each row's first. With fewer words, the whole sequence is one."""
    w = words_of(texts, lower=True)
    h = hash_spans(w.data, w.starts, w.ends)
    full, out = windows(h, w.rows, SHINGLE)
    n = w.counts
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if not len(short):
        return full, out
    size = np.diff(out)
    size[short] = 1
    rows = np.concatenate([[0], np.cumsum(size)])
    all_ = np.empty(rows[-1], U64)
    is_short = np.zeros(len(n), bool)
    is_short[short] = True
    all_[~is_short.repeat(size)] = full
    for i in short:
        x = np.full(1, n[i], U64)
        for k in range(w.rows[i], w.rows[i + 1]):
            x = mix(x * U64(31) ^ h[k : k + 1])
        all_[rows[i]] = x[0]
    return all_, rows


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, and each row's first."""
    h, rows = shingles(texts)
    size = np.diff(rows)
    for i in np.flatnonzero(size > 1):
        h[rows[i] : rows[i + 1]].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[rows[:-1][size > 0]] = True
    return h[fresh], np.concatenate([[0], np.cumsum(fresh)])[rows]


COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def _count(batches):
    n = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        n += np.bincount((shingles(batch.column("text"))[0] >> U64(46)).astype(np.int64), minlength=BUCKETS)
    seen = np.flatnonzero(n)
    yield table({"bucket": seen.astype(np.int32), "n": n[seen]}, COUNTS)


def token_counts(docs: DataFrame) -> np.ndarray:
    """Shingles of the whole corpus by hashed bucket; BUCKETS numbers come to the driver."""
    got = docs.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS, np.int64)
    n[got["bucket"]] = got["n"]
    return n


def prefix(tokens: np.ndarray, counts: np.ndarray, level: float, long: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """The rare tokens, in order, of the prefix with which a set of tokens probes, and whether the prefix holds others besides. long: ``linking.long_places``."""
    n = len(tokens)
    if not n:
        return tokens, False
    probe = n - -(-4 * n // 5) + 1
    count = counts[(tokens >> U64(46)).astype(np.int64)]
    rare = count <= level
    if long is not None:
        rare &= ~long[places_of(tokens)]
    order = np.lexsort((tokens, count, ~rare))[:probe]
    order = order[rare[order]]
    return tokens[order], len(order) < probe


PREPARED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sigs", pa.list_(pa.int64())), ("busy", pa.bool_()), ("sketch", pa.binary())])
PREPARED_DDL = "doc_id long, text_key long, n long, f1 long, f2 long, sigs array<long>, busy boolean, sketch binary"


def _prepare(batches, counts: np.ndarray, level: float):
    for batch in slices(batches):
        tokens, rows = token_sets(batch.column("text"))
        n = np.diff(rows)
        first = [np.zeros(len(n), U64), np.zeros(len(n), U64)]
        some = n > 0
        for f, seed in zip(first, (1, 2)):  # of the whole set: sums of two hashes of each token
            if len(tokens):
                f[some] = np.add.reduceat(mix(tokens + U64(seed * 0x51ED)), rows[:-1][some])
        made = [prefix(tokens[a:b], counts, level) for a, b in zip(rows, rows[1:])]
        sigs = lists(np.concatenate([np.empty(0, U64), *(m[0] for m in made)]).view(np.int64), np.concatenate([[0], np.cumsum([len(m[0]) for m in made])]), pa.int64())
        yield table({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n": n, "f1": first[0].view(np.int64), "f2": first[1].view(np.int64), "sigs": sigs, "busy": pa.array([m[1] for m in made], pa.bool_()), "sketch": pa.array([sketch(tokens[a:b]) for a, b in zip(rows, rows[1:])], pa.binary())}, PREPARED)


SIGNED = pa.schema([("node", pa.int64()), ("sigs", pa.list_(pa.int64())), ("n", pa.int64()), ("busy", pa.bool_())])


def _sign_again(batches, counts: np.ndarray, level: float, long: np.ndarray):
    for batch in batches:
        sets = batch.column("tokens")
        rows, flat = np.asarray(sets.offsets), np.asarray(sets.values).view(U64)
        made = [prefix(flat[a:b], counts, level, long) for a, b in zip(rows, rows[1:])]
        sigs = lists(np.concatenate([np.empty(0, U64), *(m[0] for m in made)]).view(np.int64), np.concatenate([[0], np.cumsum([len(m[0]) for m in made])]), pa.int64())
        yield table({"node": batch.column("node"), "sigs": sigs, "n": np.diff(rows).astype(np.int64), "busy": pa.array([m[1] for m in made], pa.bool_())}, SIGNED)


SETS = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])
SETS_DDL = "node long, tokens array<long>"


def _sets(batches):
    for batch in slices(batches):
        tokens, rows = token_sets(batch.column("text"))
        yield table({"node": batch.column("node"), "tokens": lists(tokens.view(np.int64), rows, pa.int64())}, SETS)


def components_of(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Null, empty and wordless texts have an empty set and are components of their own. Equal sets are one node, so copies
    are never paired. Rows with a null doc_id are counted and link nothing. Rows that share a doc_id each have their own
    set; what links to one of these sets links to the others, and the component is the least doc_id. Other columns are
    not read.
    """
    scratch = Scratch(docs.sparkSession)
    counts = token_counts(docs)
    mean = counts.sum() / BUCKETS
    level = float(FREQUENT * mean + 6 * np.sqrt(mean) + 2)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    prepared = scratch.stored(read.mapInArrow(lambda it: _prepare(it, shared.value, level), PREPARED_DDL).withColumn("row", F.monotonically_increasing_id()))
    whole, own = prepared.where("n > 0 and doc_id is not null"), ["n", "f1", "f2"]
    # A node is a distinct set; it is named after one of the rows that have it.
    nodes = scratch.stored(whole.groupBy(*own).agg(F.min("row").alias("node")))
    signed = only(whole, nodes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "sigs", "n", "busy", "sketch")

    def sets_of(need: DataFrame) -> TokenSets:
        at = scratch.stored(only(prepared, need.select(F.col("node").alias("row")), "row").select("doc_id", "text_key", F.col("row").alias("node")))
        sets = read.join(F.broadcast(at) if small(at) else at, ["doc_id", "text_key"]).select("node", "text").mapInArrow(_sets, SETS_DDL)
        twice = only(prepared, at, "text_key").join(at, ["doc_id", "text_key"]).groupBy("node").count().where("count > 1")
        return TokenSets(scratch.stored(sets if twice.isEmpty() else sets.dropDuplicates(["node"])))

    def again(sets: DataFrame, long: np.ndarray) -> DataFrame:
        places = docs.sparkSession.sparkContext.broadcast(np.packbits(long))
        return sets.mapInArrow(lambda it: _sign_again(it, shared.value, level, np.unpackbits(places.value).astype(bool)), "node long, sigs array<long>, n long, busy boolean")

    links = connect(signed, sets_of, scratch, 80, signed.where("busy"), signed.select("node", "sketch"), again)
    of_rows = scratch.stored(prepared.select("doc_id", *own).join(nodes, own, "left").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))))
    twice = of_rows.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    same_id = of_rows.join(twice, "doc_id").where("node > a").select("a", F.col("node").alias("b"))
    joined = components(links.union(same_id), scratch)
    comp = of_rows.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = comp.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = stored(comp.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")))
    scratch.clear()
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one document of each component stays, the one with the least doc_id. Rows that share a doc_id stay or go together; rows without one stay."""
    dropped = stored(components_of(docs).where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct())
    return only(docs, dropped, "doc_id", "left_anti").select(*docs.columns)
