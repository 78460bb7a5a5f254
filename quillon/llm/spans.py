"""Similar spans of texts (lines, paragraphs): MinHash bands, exact verification, components.

A kind of spans is a function from an Arrow array of texts to ``Spans``. Equal spans are one class, told apart by 128
bits; for signatures and links a class goes by the first 64 of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .arrow_text import U64, lists, mix, slices, table
from .families import NODES, TOKENS, compared, edges, families
from .linking import components, connect
from .minhash import bands
from .ngram_join import SETS, SETS_DDL
from .scratch import Scratch, met, only, small

#: Text bytes that are signed at once: their shingles take some hundred times as much.
AT_ONCE = 1 << 20
#: Bytes of a band's key that are compared within its partition: of 1,000,000 keys there some 0.5 pairs agree by chance, and are verified.
WIDTH = 5
#: Bands and rows by which spans of long lists are signed again, for a recall of 99.9 % at a similarity of 0.8; from so many permutations.
AGAIN_BANDS, AGAIN_ROWS, SEEDS = 64, 10, 4


@dataclass
class Spans:
    row: np.ndarray  #: row of the text of each span
    place: np.ndarray  #: of the span in its text, a number that no other span there has
    size: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    data: np.ndarray  #: bytes of all texts, as they are compared
    start: np.ndarray  #: of each span in the bytes
    end: np.ndarray
    shingles: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  #: of some spans: hashes with repetitions, and each span's first, one more than spans


Kind = Callable[[pa.Array], Spans]

FOUND = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
FOUND_DDL = "doc_id long, place int, size int, h1 long, h2 long"
SIGNED = pa.schema([("node", pa.int64()), ("sigs", pa.list_(pa.int64())), ("n", pa.int64())])


def _find(batches, kind: Kind):
    for batch in slices(batches, limit=AT_ONCE):
        s = kind(batch.column("text"))
        yield table({"doc_id": batch.column("doc_id").take(pa.array(s.row)), "place": s.place.astype(np.int32), "size": s.size.astype(np.int32), "h1": s.h1.view(np.int64), "h2": s.h2.view(np.int64)}, FOUND)


def _sign(batches, kind: Kind, shape: tuple[int, int]):
    for batch in slices(batches, limit=AT_ONCE):
        s = kind(batch.column("text"))
        fresh = np.sort(np.unique(s.h1, return_index=True)[1])  # equal spans once
        keys = bands(*s.shingles(fresh), *shape)
        yield table({"node": s.h1[fresh].view(np.int64), "sigs": lists(keys.view(np.int64).ravel(), np.arange(len(fresh) + 1) * shape[0], pa.int64()), "n": np.ones(len(fresh), np.int64)}, SIGNED)


TEXTS = pa.schema([("family", pa.int64()), ("node", pa.int64()), ("text", pa.string())])


AGAIN = pa.schema([*SIGNED, ("busy", pa.bool_())])


def _sign_again(batches):
    """Nodes of long lists by longer bands, which spans that are only half alike don't share."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sets = part.column("tokens")
            rows, flat = np.asarray(sets.offsets), np.asarray(sets.values).view(U64)
            flat, rows = flat[rows[0] : rows[-1]], rows - rows[0]
            keys = np.concatenate([bands(mix(flat + U64(k + 1)), rows, AGAIN_BANDS // SEEDS, AGAIN_ROWS) + U64(k) for k in range(SEEDS)], 1)
            yield table({"node": part.column("node"), "sigs": lists(keys.view(np.int64).ravel(), np.arange(len(keys) + 1) * AGAIN_BANDS, pa.int64()), "n": np.ones(len(keys), np.int64), "busy": pa.array(np.zeros(len(keys), bool))}, AGAIN)


def _texts(batches, kind: Kind):
    """The texts of wanted spans; they are as long as their spans, where sets would take eight bytes a token."""
    for batch in slices(batches, limit=AT_ONCE):
        s = kind(batch.column("text"))
        wanted = batch.column("wanted")
        flat = wanted.flatten()
        row, place, node, family = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets))), *(np.asarray(flat.field(c)) for c in ("place", "node", "family"))
        key = s.row.astype(np.int64) << 32 | s.place
        order = np.argsort(key, kind="stable")
        at = np.minimum(np.searchsorted(key[order], row << 32 | place), max(len(key) - 1, 0))
        if not len(key):
            continue
        pick = order[at]
        own = (key[pick] == row << 32 | place) & (s.h1.view(np.int64)[pick] == node)  # else it is of another row of that doc_id
        raw = s.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(s.start[pick[own]].tolist(), s.end[pick[own]].tolist())]
        yield table({"family": family[own], "node": node[own], "text": pa.array(texts, pa.string())}, TEXTS)


#: Bits of a token by which tokens of one text, or of a pair of texts, are told apart; the others hold the row.
TOKEN_BITS = 48
ROWS = 1 << (64 - TOKEN_BITS)


def _distinct(texts: pa.Array, one: Kind) -> np.ndarray:
    """The distinct tokens of at most ROWS texts that are a span each, as sorted numbers with the row in their upper bits."""
    shingles, rows = one(texts).shingles(np.arange(len(texts)))
    key = np.sort(np.repeat(np.arange(len(texts), dtype=U64), np.diff(rows)) << U64(TOKEN_BITS) | shingles >> U64(64 - TOKEN_BITS))
    return key[np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])]


def _few(batches, column: str, limit: int):
    """Slices of at most so many text bytes and ROWS rows."""
    for batch in slices(batches, column, limit):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _tokens(batches, one: Kind):
    for batch in _few(batches, "text", AT_ONCE):
        key = _distinct(batch.column("text"), one)
        rows = np.searchsorted(key >> U64(TOKEN_BITS), np.arange(batch.num_rows + 1, dtype=U64))
        yield table({"node": batch.column("node"), "tokens": lists(mix(key & U64((1 << TOKEN_BITS) - 1)).view(np.int64), rows, pa.int64())}, SETS)


def _alike(batches, one: Kind, percent: int):
    for batch in _few(batches, "x", AT_ONCE // 2):
        x, y = _distinct(batch.column("x"), one), _distinct(batch.column("y"), one)
        count = lambda key: np.bincount((key >> U64(TOKEN_BITS)).astype(np.int64), minlength=batch.num_rows)  # noqa: B023, E731
        every = np.sort(np.concatenate([x, y]))
        both = count(every[1:][every[1:] == every[:-1]])
        yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * both >= percent * (count(x) + count(y))))


class TextSets:
    """Sets of spans, held as a stored table (node, text); what a text's tokens are, ``one`` says."""

    def __init__(self, held: DataFrame, one: Kind):
        self.held, self.one = held, one

    def verified(self, pairs: DataFrame, percent: int) -> DataFrame:
        of = lambda node, text: self.held.select(F.col("node").alias(node), F.col("text").alias(text))
        both = pairs.select("a", "b").join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "x", "y")
        one = self.one
        return both.mapInArrow(lambda it: _alike(it, one, percent), "a long, b long")

    def of(self, nodes: DataFrame) -> DataFrame:
        one = self.one
        return only(self.held, nodes, "node").select("node", "text").mapInArrow(lambda it: _tokens(it, one), SETS_DDL)


def found(read: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, place, size, h1, h2) of every span of read (doc_id, text)."""
    return read.mapInArrow(lambda it: _find(it, kind), FOUND_DDL)


def _compare(batches, one: Kind, percent: int):
    def distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        key = _distinct(texts, one)
        return key & U64((1 << TOKEN_BITS) - 1), np.searchsorted(key >> U64(TOKEN_BITS), np.arange(len(texts) + 1, dtype=U64))

    return compared(_few(batches, "text", AT_ONCE), distinct, percent)


def similar(read: DataFrame, spans: DataFrame, kind: Kind, one: Kind, percent: int, shape: tuple[int, int], scratch: Scratch) -> DataFrame:
    """(node, comp) of the classes of the stored spans of read that links of that similarity join; node is their h1. one: the kind in which a span's own text is one span.

    Spans that shared signatures join are a family. Its texts go to one task, if they are within the limits; spans of
    larger ones are signed again and go by ``connect``.
    """
    signed = read.select("text").mapInArrow(lambda it: _sign(it, kind, shape), "node long, sigs array<long>, n long")
    family = families(scratch.settled(edges(signed, spans.count() * shape[0], WIDTH)), scratch)
    if small(family, 200_000):
        family = F.broadcast(family)
    of = spans.withColumnRenamed("h1", "node").join(family, "node").groupBy("node").agg(F.min(F.struct("doc_id", "place", "size")).alias("at"), F.first("family").alias("family"))
    found_at = scratch.settled(of)
    wanted = scratch.settled(found_at.groupBy("at.doc_id").agg(F.collect_list(F.struct("at.place", "node", "family")).alias("wanted")))
    asked = read.join(F.broadcast(wanted), "doc_id") if small(wanted, 20_000) else met(read, wanted, "doc_id")
    texts = asked.select("text", "wanted").mapInArrow(lambda it: _texts(it, kind), "family long, node long, text string")
    large = scratch.stored(found_at.groupBy("family").agg(F.sum("at.size").alias("tokens"), F.count("*").alias("nodes")).where((F.col("tokens") > TOKENS * linking.HELD) | (F.col("nodes") > NODES * linking.WIDE)).select("family"))
    if large.isEmpty():
        held = texts
    else:
        texts = scratch.stored(texts)
        held = texts.join(F.broadcast(large) if small(large) else large, "family", "left_anti")
    joined = scratch.settled(held.repartition("family").sortWithinPartitions("family", "node").mapInArrow(lambda it: _compare(it, one, percent), "node long, comp long"))
    if large.isEmpty():
        return joined
    sets = TextSets(scratch.stored(only(texts, large, "family").select("node", "text").dropDuplicates(["node"])), one)
    again = sets.of(sets.held.select("node")).mapInArrow(_sign_again, "node long, sigs array<long>, n long, busy boolean")
    links = connect(scratch.stored(again), lambda _: sets, scratch, percent, whole=True)
    return joined.union(components(links, scratch))


def long_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte span, none of them empty: sums over its eight-byte lanes, each mixed with its place."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    lanes = -(-size // 8)
    first = np.concatenate([[0], np.cumsum(lanes)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], lanes)
    left = np.minimum(np.repeat(size, lanes) - 8 * k, 8)
    lane = at8[np.repeat(starts, lanes) + 8 * k] & (~U64(0) >> (U64(64) - U64(8) * left.astype(U64)))
    x = mix(lane ^ mix(k.astype(U64) + U64(1)))
    total = lambda y: np.add.reduceat(y, first[:-1]) if len(size) else np.zeros(0, U64)
    length = size.astype(U64)
    return mix(total(x) ^ length), mix(total(mix(x + U64(0x9E3779B97F4A7C15))) + length)
