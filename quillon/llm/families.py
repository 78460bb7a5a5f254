"""Families: nodes that shared signatures join, directly or by others. Similar nodes are looked for inside a family only, which one task compares whole.

Nodes of a signature are joined as a star around one of them, so a signature that many nodes have gives as many rows as it
has nodes, and no pairs. A family within the limits is compared exactly, by matrix products of its tokens: those that many
of its nodes have are columns, the others give a bound and are counted where it doesn't settle a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, mix, table, tidy
from .linking import DEALT_TO, GATHERED, _cut, _uncut
from .scratch import Scratch

#: Tokens (8 bytes each) and nodes of a family that one task compares, for each of ``linking.HELD`` and ``linking.WIDE``.
TOKENS, NODES = 16, 4
#: Nodes of a family whose pairs are counted together with those of other families.
FEW = 4
#: Rows of a family's matrix that are multiplied at once, and as how many columns' nodes a token must have to be one: a share of 1 / DENSE.
BLOCK, DENSE = 256, 16

DEALT = pa.schema([("part", pa.int32()), ("sigs", pa.binary()), ("nodes", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
CLASSES = pa.schema([("node", pa.int64()), ("comp", pa.int64())])


def stars(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each signature once with one of its nodes, and edges (a, b) from that node to its others."""
    order = np.argsort(sigs)
    sigs, nodes = sigs[order], nodes[order]
    lead = np.concatenate([np.ones(min(len(sigs), 1), bool), sigs[1:] != sigs[:-1]])
    first = np.flatnonzero(lead)
    other = np.flatnonzero(~lead)
    a, b = nodes[first[np.cumsum(lead)[other] - 1]], nodes[other]
    return sigs[first], nodes[first], a[a != b], b[a != b]


def merged(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label of each node (a number below their count, its own at first) when edges join a's and b's labels."""
    comp = comp.copy()
    while len(a):
        x, y = comp[a], comp[b]
        some = x != y
        a, b, x, y = a[some], b[some], x[some], y[some]
        to = np.arange(len(comp))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to != (further := to[to])).any():
            to = further
        comp = to[comp]
    return comp


def _trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the given ones, each node to the least one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    comp = merged(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    some = np.flatnonzero(comp != np.arange(len(nodes)))
    return nodes[comp[some]], nodes[some]


def _deal(batches, parts: int, width: int):
    """Signatures by their partition, many in a row, one of each from a gathering; the edges to its other nodes go by these."""
    held, size = [], 0

    def out():
        sigs, nodes, a, b = stars(*(np.concatenate(x) for x in zip(*held)))
        a, b = _trees(a, b)
        pieces = []
        for by, columns in ((sigs, (sigs, nodes)), (b, (a, b))):
            part = (mix(by.view(U64)) % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            pieces.append((np.searchsorted(part[order], np.arange(parts + 1)), *(x[order] for x in columns)))
        (cut, sigs, nodes), (cut_b, a, b) = pieces
        here = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_b) > 0))
        column = lambda x, at: pa.array([x[at[p] : at[p + 1]].tobytes() for p in here], pa.binary())
        keys = pa.array([_cut(sigs[cut[p] : cut[p + 1]], width) for p in here], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), keys, column(nodes, cut), column(a, cut_b), column(b, cut_b)], schema=DEALT)

    for batch in batches:
        sigs = batch.column("sigs")
        held.append((np.asarray(sigs.flatten()), np.asarray(batch.column("node")).repeat(np.diff(np.asarray(sigs.offsets)))))
        size += len(held[-1][0])
        if size >= GATHERED:
            yield out()
            held, size = [], 0
    if size:
        yield out()
        held = []
    tidy()


def _meet(batches, width: int):
    read: list[list] = [[], [], [], []]
    for batch in batches:
        for x, c in zip(read, ("sigs", "nodes", "a", "b")):
            x += [_uncut(v, width) if c == "sigs" else np.frombuffer(v, np.int64) for v in batch.column(c).to_pylist()]
    if not read[0]:
        return
    sigs, nodes, a, b = (np.concatenate(x) for x in read)
    del read
    _, _, more_a, more_b = stars(sigs, nodes)
    del sigs, nodes
    a, b = _trees(np.concatenate([a, more_a]), np.concatenate([b, more_b]))
    for at in range(0, len(a), 1 << 17):
        yield table({"a": a[at : at + (1 << 17)], "b": b[at : at + (1 << 17)]}, EDGES)
    tidy()


def edges(signed: DataFrame, sigs: int, width: int = 8) -> DataFrame:
    """Edges (a, b) that join the nodes of each signature of rows (node, sigs: array of longs). sigs: how many there are; width: as for ``linking.met``."""
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), sigs // DEALT_TO)
    columns = "part int, sigs binary, nodes binary, a binary, b binary"
    dealt = signed.select("node", "sigs").mapInArrow(lambda it: _deal(it, parts, width), columns)
    return dealt.repartition(parts, "part").mapInArrow(lambda it: _meet(it, width), "a long, b long")


def _contract(batches):
    """Edges that join what those of a partition join, and a row of nulls if they aren't yet stars around least nodes: rows (k, a, b) hold all edges of their nodes k."""
    read: list[list] = [[], [], []]
    for batch in batches:
        for x, c in zip(read, "kab"):
            x.append(np.asarray(batch.column(c)))
    if not read[0]:
        return
    k, a, b = (np.concatenate(x) for x in read)
    del read
    other = np.where(k == a, b, a)
    order = np.lexsort((other, k))
    k, other = k[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    last = np.append(first[1:], len(k)) - 1
    leaf = (other[first] == other[last]) & (other[first] < k[first])
    settled = (leaf | (other[first] > k[first])).all()
    a, b = _trees(a, b)
    for at in range(0, len(a), 1 << 17):
        yield table({"a": a[at : at + (1 << 17)], "b": b[at : at + (1 << 17)]}, EDGES)
    if not settled:
        yield table({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())}, EDGES)
    tidy()


def families(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, family) of every node of the stored edges (a, b): family is the least node that they reach. All edges of a node come to one partition, which joins all that it can; so few rounds are needed."""
    while True:
        dealt = edges.select(F.col("a").alias("k"), "a", "b").union(edges.select(F.col("b").alias("k"), "a", "b")).repartition("k")
        made = scratch.settled(dealt.mapInArrow(_contract, "a long, b long"))
        edges = made.where("a is not null")
        if made.where("a is null").isEmpty():
            stars_ = edges.select(F.col("b").alias("node"), F.col("a").alias("family"))
            return scratch.settled(stars_.union(edges.select("a", "a")).distinct())


def classes(rows: np.ndarray, tokens: np.ndarray, percent: int) -> np.ndarray:
    """A label for each node of a family, equal where links of that similarity join them. tokens: distinct ones of each node, from ``rows`` on (one more than nodes)."""
    n, size = len(rows) - 1, np.diff(rows)
    # Tokens of one node can't be common to two.
    known = np.sort(tokens)
    known = known[1:][known[1:] == known[:-1]]
    known = known[np.concatenate([np.ones(min(len(known), 1), bool), known[1:] != known[:-1]])]
    if not len(known):
        return np.arange(n)
    token, node = [], []
    for k in range(0, n, 1024):  # a part at a time, for its memory
        own = tokens[rows[k] : rows[min(k + 1024, n)]]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1).astype(np.int32)
        common = known[at] == own
        token.append(at[common])
        node.append(np.repeat(np.arange(k, min(k + 1024, n), dtype=np.int32), size[k : k + 1024])[common])
    token, node = np.concatenate(token), np.concatenate(node)
    df = np.bincount(token, minlength=len(known))
    dense = df >= n // DENSE
    column = np.cumsum(dense) - 1
    some = dense[token]
    held = np.zeros((n, int(dense.sum())), np.uint8)
    held[node[some], column[token[some]]] = 1
    # The other tokens, and each one's nodes.
    loose_node, loose_token = node[~some], token[~some]
    loose = np.bincount(loose_node, minlength=n)
    own = np.concatenate([[0], np.cumsum(loose)])
    order = np.argsort(loose_token, kind="stable")
    holder, first = loose_node[order], np.searchsorted(loose_token[order], np.arange(len(known) + 1))
    # The nodes with the most common tokens come first: what is joined to them by then need not be looked at again.
    central = np.argsort(-np.bincount(node, df[token], n) / np.maximum(size, 1), kind="stable")
    comp, at, step, main = np.arange(n), 0, 8, None
    while at < n:
        here = central[at : at + step]
        at, step = at + step, BLOCK
        if main is not None:
            here = here[comp[here] != comp[main]]
            if not len(here):
                continue
        mine = held[here].astype(np.float32)
        both = np.concatenate([mine @ held[k : k + 1024].T.astype(np.float32) for k in range(0, n, 1024)], 1)
        least = percent * (size[here, None] + size) / (100 + percent)
        sure = both >= least - 1e-3
        able = both + np.minimum(loose[here, None], loose) >= least - 1e-3
        for k, i in enumerate(here.tolist()):
            if not size[i]:
                continue
            found = sure[k]
            if loose[i] and (able[k] & ~found & (comp != comp[i])).any():
                t = loose_token[own[i] : own[i + 1]]
                length = first[t + 1] - first[t]
                where = np.repeat(first[t] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                whole = np.rint(both[k]).astype(np.int64) + np.bincount(holder[where], minlength=n)
                found = (100 + percent) * whole >= percent * (size[i] + size)
            labels = comp[found]
            if len(labels) and (labels != comp[i]).any():
                to = np.arange(n)
                to[labels] = to[comp[i]] = min(labels.min(), comp[i])
                comp = to[comp]
        if main is None:
            main = np.bincount(comp).argmax()  # a node of the largest class by now: labels are their least nodes
    return comp


def few_classes(start: np.ndarray, rows: np.ndarray, tokens: np.ndarray, percent: int) -> np.ndarray:
    """As ``classes`` for families of at most FEW nodes each, that begin at ``start`` (one more than families); labels are rows."""
    n, size = len(rows) - 1, np.diff(rows)
    family = np.repeat(np.arange(len(start) - 1), np.diff(start))
    place = np.arange(n) - start[family]
    # Sorted numbers of family, token and the node's place; the lowest two bits of a token give way to the place.
    key = np.sort(np.repeat(family.astype(U64) << U64(48) | place.astype(U64), size) | (tokens >> U64(2)) << U64(2))
    both = np.zeros((n, FEW), np.int64)
    for k in range(1, FEW):
        met = np.flatnonzero(key[k:] >> U64(2) == key[:-k] >> U64(2))
        i, j = (key[met] & U64(3)).astype(np.int64), (key[met + k] & U64(3)).astype(np.int64)
        both += np.bincount((start[(key[met] >> U64(48)).astype(np.int64)] + i) * FEW + j, minlength=n * FEW).reshape(n, FEW)
    i, j = np.nonzero(both)
    other = start[family[i]] + j
    linked = (100 + percent) * both[i, j] >= percent * (size[i] + size[other])
    return merged(np.arange(n), i[linked], other[linked])


def _compared(comp: np.ndarray, node: np.ndarray, rows: np.ndarray, tokens: np.ndarray, percent: int) -> pa.RecordBatch:
    """Classes of more than one node, of whole families whose rows lie together, sorted by nodes."""
    once = np.concatenate([np.ones(min(len(node), 1), bool), (node[1:] != node[:-1]) | (comp[1:] != comp[:-1])])
    if not once.all():  # rows of one doc_id had the same text
        tokens = tokens[np.repeat(once, np.diff(rows))]
        rows = np.concatenate([[0], np.cumsum(np.diff(rows)[once])])
        comp, node = comp[once], node[once]
    start = np.concatenate([np.flatnonzero(np.concatenate([np.ones(min(len(comp), 1), bool), comp[1:] != comp[:-1]])), [len(comp)]])
    length, label = np.diff(start), np.arange(len(node))
    few = np.flatnonzero((length <= FEW) & (length > 1))
    if len(few):
        pick = np.repeat(start[few] - np.concatenate([[0], np.cumsum(length[few])[:-1]]), length[few]) + np.arange(length[few].sum())
        size = np.diff(rows)[pick]
        at = np.concatenate([[0], np.cumsum(size)])
        own = tokens[np.repeat(rows[pick] - at[:-1], size) + np.arange(at[-1])]
        label[pick] = pick[few_classes(np.concatenate([[0], np.cumsum(length[few])]), at, own, percent)]
    for k in np.flatnonzero(length > FEW).tolist():
        a, b = start[k], start[k + 1]
        label[a:b] = a + classes(rows[a : b + 1] - rows[a], tokens[rows[a] : rows[b]], percent)
    several = np.bincount(label, minlength=len(node))[label] > 1
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    return table({"node": node[several], "comp": least[label][several]}, CLASSES)


def compared(batches: Iterator[pa.RecordBatch], distinct: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], percent: int) -> Iterator[pa.RecordBatch]:
    """(node, comp) from rows (family, node, text) of whole families, those of a family one after another. distinct: tokens below 2^48 of texts, without repetitions, and each text's first."""
    held: list[tuple] = []
    for batch in batches:
        tokens, rows = distinct(batch.column("text"))
        family, node = (np.asarray(batch.column(c)) for c in ("family", "node"))
        held.append((family, node, np.diff(rows), tokens))
        if held[0][0][0] == family[-1]:  # one family so far
            continue
        family, node, size, tokens = (np.concatenate(x) for x in zip(*held))
        cut = int(np.flatnonzero(family != family[-1])[-1]) + 1
        rows = np.concatenate([[0], np.cumsum(size)])
        yield _compared(family[:cut], node[:cut], rows[: cut + 1], tokens[: rows[cut]], percent)
        held = [(family[cut:], node[cut:], size[cut:], tokens[rows[cut] :].copy())]
    if held:
        family, node, size, tokens = (np.concatenate(x) for x in zip(*held))
        held = []
        yield _compared(family, node, np.concatenate([[0], np.cumsum(size)]), tokens, percent)
    tidy()
