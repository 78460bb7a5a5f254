"""From shared signatures to components: candidate pairs, exact verification and distributed union-find.

Nodes that share a signature form its list. Short lists give pairs. The nodes of longer lists are compared by an exact
prefix join of their own instead: tokens that only one of these nodes has can't be common to any two and are left out, the
rest is ordered by exact counts among these nodes. Its lists are linked as stars around the node with the fewest tokens of
its own, nodes whose common tokens cannot suffice are pruned, and pairs are made only between nodes that the verified star
links haven't joined; long lists that are still open are split by combinations of tokens first. Components come out the
same as with all pairs: a pair inside one component cannot join anything.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, lists, mix, table, tidy
from .scratch import Scratch, only, small

#: Nodes of a list that gives pairs; those of longer lists go to the prefix join.
CAP = 32
#: Signatures that a task gathers before it deals them out, and that a partition has on average.
GATHERED, DEALT_TO = 1 << 19, 1 << 20
#: Rounds of star links in the prefix join, at most; they end when all remaining pairs are at most FEW for each row of the lists.
STARS, FEW = 2, 4
#: Nodes of a list whose pairs the prefix join looks at, one by one, to make those that may be similar; longer lists are split first.
WIDE = 4096
#: Tokens of all nodes of a list that one task compares whole (8 bytes each).
HELD = 1 << 20
#: A frequent token is combined with another one; those that more nodes have with two others.
COMMON = 32 * CAP
#: Places in a table of bits for the signatures of long lists; 64 of them are a row that comes to the driver.
LONG_PLACES = 1 << 24

DEALT = pa.schema([("part", pa.int32()), ("sigs", pa.binary()), ("nodes", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("many", pa.binary())])
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("m", pa.int32()), ("n", pa.int32())])


def _cut(x: np.ndarray, width: int) -> bytes:
    """Of each 64-bit number the lower bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _uncut(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view(np.int64).ravel()


def _deal(batches, parts: int, width: int):
    """Signatures by their partition, many in a row. Of a signature that one gathering holds more than CAP times, one row goes there, and its nodes are known to belong to a long list."""
    held, size = [], 0

    def out():
        sigs, nodes, at, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(sigs, kind="stable")
        sigs = sigs[order]
        first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        count = np.diff(np.append(first, len(sigs)))
        many = np.repeat(count > CAP, count)
        lead = np.zeros(len(sigs), bool)
        lead[first] = True
        of_many = np.unique(nodes[order[many]])
        pick = order[~many | lead]
        key = sigs[~many | lead]
        flag = (many & lead)[~many | lead]
        part = (mix(key.view(U64)) % U64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        part_of_many = (mix(of_many.view(U64)) % U64(parts)).astype(np.int64)
        by_many = np.argsort(part_of_many, kind="stable")
        cuts, cuts_many = np.searchsorted(part[by], np.arange(parts + 1)), np.searchsorted(part_of_many[by_many], np.arange(parts + 1))
        here = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(cuts_many) > 0))
        cut = lambda x: pa.array([x[by[cuts[p] : cuts[p + 1]]].tobytes() for p in here], pa.binary())
        key = pa.array([_cut(key[by[cuts[p] : cuts[p + 1]]], width) for p in here], pa.binary())
        sent = pa.array([of_many[by_many[cuts_many[p] : cuts_many[p + 1]]].tobytes() for p in here], pa.binary())
        # A row that stands for a long list is marked by a size below 0.
        return pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), key, cut(nodes[pick]), cut(at[pick]), cut(np.where(flag, -1, n[pick]).astype(np.int32)), sent], schema=DEALT)

    for batch in batches:
        sigs = batch.column("sigs")
        rows = np.asarray(sigs.offsets)
        k = np.diff(rows)
        place = (np.arange(k.sum()) - np.repeat(rows[:-1] - rows[0], k)).astype(np.int32)
        held.append((np.asarray(sigs.flatten()), np.asarray(batch.column("node")).repeat(k), place, np.asarray(batch.column("n")).astype(np.int32).repeat(k)))
        size += len(place)
        if size >= GATHERED:
            yield out()
            held, size = [], 0
    if size:
        yield out()
        held = []
    tidy()


def _meet(batches, percent: int, width: int):
    """Pairs of short lists (a < b); nodes of long ones as rows with b null, and these lists' signatures as rows with a size of -1 besides."""
    read: list[list] = [[], [], [], [], []]
    kinds = (("sigs", np.int64), ("nodes", np.int64), ("at", np.int32), ("n", np.int32), ("many", np.int64))
    for batch in batches:
        for x, (c, kind) in zip(read, kinds):
            x += [_uncut(b, width) if c == "sigs" else np.frombuffer(b, kind) for b in batch.column(c).to_pylist()]
    if not read[0]:
        return
    sigs, nodes, place, n, many = (np.concatenate(x) for x in read)
    del read
    order = np.lexsort((nodes, sigs))
    sigs, nodes, place, n = sigs[order], nodes[order], place[order], n[order]
    again = np.zeros(len(sigs), bool)
    again[1:] = (sigs[1:] == sigs[:-1]) & (nodes[1:] == nodes[:-1])
    if again.any():  # a node that has a signature twice; a mark of a long list counts for both
        n[np.flatnonzero(again) - 1] = np.minimum(n[np.flatnonzero(again) - 1], n[again])
        sigs, nodes, place, n = sigs[~again], nodes[~again], place[~again], n[~again]
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    size = np.diff(np.append(first, len(sigs)))
    long = (size > CAP) | (np.minimum.reduceat(n, first) < 0)
    for kind, of_long in ((0, np.unique(np.concatenate([many, nodes[np.repeat(long, size)]]))), (-1, sigs[first[long]])):
        for at in range(0, len(of_long), 1 << 17):
            x = of_long[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), *[pa.array(np.full(len(x), kind, np.int32))] * 4], schema=MET)
    for c in range(2, CAP + 1):
        those = first[(size == c) & ~long]
        left, right = np.triu_indices(c, 1)
        step = max(1, (1 << 17) // len(left))
        for at in range(0, len(those), step):
            a, b = (those[at : at + step, None] + left).ravel(), (those[at : at + step, None] + right).ravel()
            able = 100 * np.minimum(n[a], n[b]).astype(np.int64) >= percent * np.maximum(n[a], n[b]).astype(np.int64)
            a, b = a[able], b[able]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b]), pa.array(place[a]), pa.array(place[b]), pa.array(n[a]), pa.array(n[b])], schema=MET)
    del sigs, nodes, place, n, many, order, again
    tidy()


def met(signed: DataFrame, percent: int, sigs: int | None = None, width: int = 8) -> DataFrame:
    """From rows (node, sigs: array of longs, n: size of its set, or 1 for all where it isn't known), without a null: pairs (a, b, i, j, m, n) of each short list, with the places of the signature and the sizes; nodes a of long lists, where b is null; and their signatures a, where n is -1.

    Signatures are dealt to partitions by themselves, packed in binary rows: most are alone and go no further. sigs: how
    many they are, if that is known. width: bytes of a signature that are compared within its partition; less than all
    make some more pairs, and the places of their signatures then say nothing.
    """
    if sigs is None:
        sigs = signed.agg(F.sum(F.size("sigs"))).first()[0] or 0
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), sigs // DEALT_TO)
    columns = "part int, sigs binary, nodes binary, at binary, n binary, many binary"
    return signed.select("node", "sigs", "n").mapInArrow(lambda it: _deal(it, parts, width), columns).repartition(parts, "part").mapInArrow(lambda it: _meet(it, percent, width), "a long, b long, i int, j int, m int, n int")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node of links (a, b): comp is the least node that links reach. Least labels of neighbours and jumps along labels, until nothing changes."""
    both = links.select("a", "b").union(links.select("b", "a")).union(links.select("a", F.col("a"))).union(links.select("b", F.col("b"))).toDF("a", "b").distinct()
    edges = scratch.stored(both)
    labels = scratch.stored(edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("least"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("old"))
        jump = labels.select(F.col("node").alias("least"), F.col("comp").alias("next"))
        moved = scratch.stored(near.join(jump, "least").select(F.col("a").alias("node"), F.col("next").alias("comp"), "old"))
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union. sets: (node, tokens), tokens distinct."""
    of = lambda node, tokens: sets.select(F.col("node").alias(node), F.col("tokens").alias(tokens))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(of("b", "y"), "b").join(of("a", "x"), "a").where((100 + percent) * common >= percent * (F.size("x") + F.size("y"))).select("a", "b")


class TokenSets:
    """Sets of nodes, held as a stored table (node, tokens)."""

    def __init__(self, held: DataFrame):
        self.held = held

    def verified(self, pairs: DataFrame, percent: int) -> DataFrame:
        return verified(pairs, self.held, percent)

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, tokens) of stored nodes."""
        return only(self.held, nodes, "node")


def _most(k: Column, i: Column, j: Column, m: Column, n: Column) -> Column:
    """The largest overlap of two sets of m and n tokens that have k of their signatures' tokens in common, the last at i and j: what follows is at most what is left of either."""
    return k + F.least(m - 1 - i, n - 1 - j)


def _enough(k: Column, i: Column, j: Column, m: Column, n: Column, percent: int) -> Column:
    return (m == 1) | ((100 + percent) * _most(k, i, j, m, n) >= percent * (m + n))


def _able(m: str, n: str, l_m: str, l_n: str, percent: int) -> Column:
    """Whether the sizes allow the similarity, and the tokens that either shares with any node at all."""
    m, n, most = F.col(m), F.col(n), F.least(l_m, l_n)
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * most >= percent * (m + n))


COMBINED = pa.schema([("node", pa.int64()), ("sigs", pa.list_(pa.int64())), ("indexed", pa.int32())])


def hash_of(numbers: tuple[int, ...]) -> int:
    h = 0
    for x in numbers:
        h = (h ^ (x & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def size_bin(n: int) -> int:
    """Bins of ratio 5/4: a set that overlaps enough with a set of n tokens is in the same bin or a neighbour's."""
    return int(np.floor(np.log(n) / np.log(1.25) + 1e-9))


def combined(tokens: np.ndarray, count: np.ndarray, n: int, percent: int) -> tuple[list[int], int]:
    """Signatures of a set of n tokens with which it probes, and how many of these, the first, it is indexed with.

    tokens: those that may be common to a partner, by rising count. They are combined within hashed groups of their class
    (COMMON). A group with c tokens covers c - k + 1 of them; the prefix is extended until it covers one token more than
    may be missing from a partner. Groups depend on the size: the smaller set of a pair names the bin, and a set probes
    its own bin and the one below.
    """
    probe, index = len(tokens) + percent * n // -100 + 1, len(tokens) + 2 * percent * n // -(100 + percent) + 1
    if probe <= 0:
        return [], 0
    # Combinations can't cover so few: single tokens.
    single = tokens[:probe].tolist() if n <= 5 else []
    if n < 5:
        return single, min(max(index, 0), len(single))
    own, cut = _groups(tokens, count, probe, index, size_bin(n))
    below, _ = _groups(tokens, count, probe, 0, size_bin(n) - 1)
    return single + own + below, len(single) + cut if index > 0 else 0


def _groups(tokens: np.ndarray, count: np.ndarray, probe: int, index: int, bin_: int) -> tuple[list[int], int]:
    """Combinations within groups until ``probe`` tokens are covered, and how many of them come before ``index`` are."""
    groups = max(1, int(1.25**bin_ / 20))
    group = (mix(tokens.view(U64) ^ U64(bin_ + 1)) % U64(groups)).astype(np.int64)
    seen: dict[tuple[int, int], list[int]] = {}
    out: list[int] = []
    covered, cut = 0, 0 if index <= 0 else None
    for token, g, k in zip(tokens.tolist(), group.tolist(), np.where(count > COMMON, 3, 2).tolist()):
        before = seen.setdefault((k, g), [])
        if len(before) >= k - 1:
            out += [hash_of((bin_, *more, token)) for more in combinations(before, k - 1)]
            covered += 1
        before.append(token)
        if cut is None and covered >= index:
            cut = len(out)
        if covered >= probe:
            break
    return out, len(out) if cut is None else cut


def _combine(batches, percent: int):
    for batch in batches:
        kept = batch.column("kept")
        rows = np.asarray(kept.offsets)
        flat = kept.values
        count, token = np.asarray(flat.field("df")), np.asarray(flat.field("t"))
        made = [combined(token[a:b], count[a:b], n, percent) for a, b, n in zip(rows, rows[1:], batch.column("n").to_pylist())]
        sigs = np.array([x for m in made for x in m[0]], object)
        sigs = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in sigs], U64).view(np.int64)
        yield table({"node": batch.column("node"), "sigs": lists(sigs, np.concatenate([[0], np.cumsum([len(m[0]) for m in made])]), pa.int64()), "indexed": np.array([m[1] for m in made], np.int32)}, COMBINED)


def _with_comp(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    if joined is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(now: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows of the lists that hold several components, without nodes that have too few tokens for any partner there; c: the list's length."""
    least = now.groupBy("sig").agg(F.min("n").alias("least"))
    partner = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    fit = now.join(least, "sig").where((100 + percent) * F.col("l") >= percent * (F.col("n") + partner)).drop("least")
    several = fit.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("indexed").alias("some"), F.count("*").alias("c")).where("lo < hi and some").select("sig", "c")
    return scratch.stored(fit.join(several, "sig"))


def _pairs(rows: DataFrame, percent: int, centred: bool = False) -> DataFrame:
    """Pairs of rows of a list whose components differ and whose sizes allow it; the smaller set of a pair is the indexed one. centred: with the bound of ``_about``."""
    l, r = rows.alias("l"), rows.alias("r")
    smaller = F.when((F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & F.col("l.indexed")), F.col("l.indexed")).otherwise(F.col("r.indexed"))
    condition = (F.col("l.sig") == F.col("r.sig")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.comp") != F.col("r.comp")) & smaller & _able("l.n", "r.n", "l.l", "r.l", percent)
    if centred:
        most = F.least("l.inside", "r.inside") + F.least(F.col("l.l") - F.col("l.inside"), F.col("r.l") - F.col("r.inside"))
        condition &= (F.col("l.centre") != F.col("r.centre")) | ((100 + percent) * most >= percent * (F.col("l.n") + F.col("r.n")))
    return l.join(r, condition).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def _about(pairs: DataFrame, kept: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, centre, inside) of star pairs (a: centre, b: node): how many of the node's frequent tokens the centre has. Two nodes of one centre share no more of them inside it, and outside it, than either has there."""
    of = kept.select(F.col("node").alias("b"), F.transform("frequent", lambda x: x.t).alias("own"))
    return pairs.join(of, "b").join(sets.select(F.col("node").alias("a"), "tokens"), "a").select(F.col("b").alias("node"), F.col("a").alias("centre"), F.size(F.array_intersect("own", "tokens")).alias("inside"))


def forest(nodes: np.ndarray, comps: np.ndarray, sizes: np.ndarray, rows: np.ndarray, tokens: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of a list's nodes, each with the size of its set, links that join the components which all its similar pairs join: one fewer than it joins at most.

    tokens: the distinct ones of each node that may be common to another, from ``rows`` on (one more than nodes). Overlaps
    are exact: each node's are counted along its tokens' own lists, but for nodes that the largest component has by then.
    """
    c = len(nodes)
    _, token = np.unique(tokens, return_inverse=True)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(c), np.diff(rows))[order]
    first = np.searchsorted(token[order], np.arange(len(token) and token.max() + 2))
    _, comp = np.unique(comps, return_inverse=True)
    left, out, main = comp.max(initial=0), [], -1
    for k, i in enumerate(np.argsort(sizes, kind="stable")):
        if not left:
            break
        if k == 1:  # of two nodes that are apart, one at least is outside the largest component
            main = np.bincount(comp).argmax()
        if comp[i] == main:
            continue
        own = token[rows[i] : rows[i + 1]]
        size = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(own) else own
        both = np.bincount(holder[at], minlength=c)
        for j in np.flatnonzero(((100 + percent) * both >= percent * (sizes[i] + sizes)) & (comp != comp[i])).tolist():
            if comp[i] != comp[j]:
                out.append((int(nodes[min(i, j)]), int(nodes[max(i, j)])))
                one, other = (comp[j], comp[i]) if comp[j] == main else (comp[i], comp[j])
                comp[comp == other] = one
                left -= 1
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forests(batches, percent: int):
    for batch in batches:
        column = batch.column("held")
        cuts, flat = np.asarray(column.offsets), column.values
        node, comp, n = (np.asarray(flat.field(x)) for x in ("node", "comp", "n"))
        of, tokens = np.asarray(flat.field("tokens").offsets), np.asarray(flat.field("tokens").values)
        links = [x for a, b in zip(cuts, cuts[1:]) for x in forest(node[a:b], comp[a:b], n[a:b].astype(np.int64), of[a : b + 1] - of[a], tokens[of[a] : of[b]], percent)]
        yield table({"a": np.array([x[0] for x in links], np.int64), "b": np.array([x[1] for x in links], np.int64)}, LINKS)
    tidy()


def _compared(now: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from lists that are compared whole, one of those that hold the same nodes."""
    same = now.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.count("*").alias("k"))
    one = same.groupBy("x", "y", "k").agg(F.min("sig").alias("sig")).select("sig")
    tokens = kept.select("node", "n", F.transform("kept", lambda x: x.t).alias("tokens"))
    rows = now.select("sig", "node", "comp").join(one, "sig", "left_semi").join(tokens, "node")
    held = rows.groupBy("sig").agg(F.collect_list(F.struct("node", "comp", "n", "tokens")).alias("held")).select("held")
    return held.mapInArrow(lambda it: _forests(it, percent), "a long, b long").distinct()


def prefix_join(sets: DataFrame, percent: int, scratch: Scratch, whole: bool = False) -> DataFrame | None:
    """Links (a, b) that join every component of the stored sets (node, tokens) under the similarity; None if there are none.

    whole: for sets so small that each list may hold them; lists of up to WIDE nodes and HELD tokens are then compared by
    one task each, which gives links and no pairs. Longer ones go on as without it.

    Two sets that are similar share a token of their prefixes. If they share none that CAP nodes or fewer have, then all
    that they share are frequent tokens: by the number of these, most nodes of long lists are seen to have no partner.
    """
    each = sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    df = each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    kept = each.join(df, "t").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("kept")).withColumn("l", F.size("kept"))
    kept = scratch.stored(kept.where(100 * F.col("l") >= percent * F.col("n")).withColumn("frequent", F.filter("kept", lambda x: x.df > CAP)))
    probe = F.expr(f"cast(l - ceil({percent} * n / 100) + 1 as int)")
    index = F.expr(f"l - ceil({2 * percent} * n / {100 + percent}) + 1")
    placed = kept.select("node", "n", "l", F.size("frequent").alias("f"), index.alias("index"), F.posexplode(F.slice("kept", F.lit(1), probe)).alias("at", "x"))
    rows = scratch.stored(placed.select(F.col("x.t").alias("sig"), "node", "n", F.when(F.col("x.df") > CAP, F.col("f")).otherwise(F.col("l")).alias("l"), (F.col("at") < F.col("index")).alias("indexed")))
    scratch.settle()
    links, joined, tried, about = None, None, None, None
    now = _open(_with_comp(rows, None), percent, scratch)
    for k in range(STARS):
        lengths = now.groupBy("sig").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("pairs"), F.sum("c").alias("rows")).first()
        if not lengths["rows"] or lengths["pairs"] <= FEW * lengths["rows"]:
            break
        rank = F.struct(F.xxhash64("node", F.lit(k)) if k else F.col("n") - F.col("l"), "node", "n", "l", "comp")
        centres = now.groupBy("sig").agg(F.min(rank).alias("c")).select("sig", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "n", "l", "comp")))
        near = now.join(centres, "sig").where((F.col("comp") != F.col("c_comp")) & _able("n", "c_n", "l", "c_l", percent)).groupBy("node", F.col("c_node").alias("centre")).agg(F.count("*").alias("times"))
        if tried is not None:
            near = near.join(tried, (near.node == tried.b) & (near.centre == tried.a), "left_anti")
        pairs = scratch.stored(near.groupBy("node").agg(F.max(F.struct("times", (-F.col("centre")).alias("c"))).alias("best")).select((-F.col("best.c")).alias("a"), F.col("node").alias("b")))
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        if about is None:
            about = scratch.stored(_about(pairs, kept, sets))
        found = scratch.stored(verified(pairs, sets, percent))
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        joined = components(links, scratch)
        now = _open(_with_comp(now.drop("comp", "c"), joined), percent, scratch)
    if whole:
        light = now.groupBy("sig").agg(F.count("*").alias("k"), F.sum("l").alias("tokens")).where((F.col("k") <= WIDE) & (F.col("tokens") <= HELD)).select("sig")
        compared = scratch.stored(_compared(now.join(light, "sig", "left_semi"), kept, percent))
        if not compared.isEmpty():
            links = compared if links is None else links.union(compared)
        now = scratch.stored(now.join(light, "sig", "left_anti"))
        if now.isEmpty():
            return links
        if links is not None:
            joined = components(links, scratch)
            now = _open(_with_comp(now.drop("comp", "c"), joined), percent, scratch)
    pairs = _pairs(now.where(F.col("c") <= CAP), percent)
    if about is not None:
        wide = now.where((F.col("c") > CAP) & (F.col("c") <= WIDE)).join(about, "node", "left").withColumns({"centre": F.coalesce("centre", "node"), "inside": F.coalesce("inside", "l")})
        pairs = pairs.union(_pairs(wide, percent, centred=True))
    else:
        pairs = pairs.union(_pairs(now.where((F.col("c") > CAP) & (F.col("c") <= WIDE)), percent))
    long = scratch.stored(now.where(F.col("c") > WIDE).select("node").distinct())
    if not long.isEmpty():
        made = kept.join(long, "node").select("node", "n", F.col("frequent").alias("kept")).mapInArrow(lambda it: _combine(it, percent), "node long, sigs array<long>, indexed int")
        split = made.select("node", "indexed", F.posexplode("sigs").alias("at", "sig")).groupBy("node", "sig").agg(F.max(F.col("at") < F.col("indexed")).alias("indexed"))
        several = split.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
        lists_ = split.join(several, "sig").join(kept.select("node", "n", F.size("frequent").alias("l")), "node")
        pairs = pairs.union(_pairs(_open(_with_comp(lists_, joined), percent, scratch), percent))
    pairs = pairs.distinct()
    if tried is not None:
        pairs = pairs.join(tried.select("a", "b").union(tried.select("b", "a")), ["a", "b"], "left_anti")
    pairs = scratch.stored(pairs)
    if not pairs.isEmpty():
        sketches = scratch.stored(sets.mapInArrow(_sketches, "node long, n long, sketch binary"))
        of = lambda node, n, bits: sketches.select(F.col("node").alias(node), F.col("n").alias(n), F.col("sketch").alias(bits))
        pairs = pairs.join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b").mapInArrow(lambda it: _sketched(it, percent), "a long, b long")
        found = scratch.stored(verified(scratch.stored(pairs), sets, percent))
        links = found if links is None else links.union(found)
    return links


def places_of(sigs: np.ndarray) -> np.ndarray:
    return (mix(sigs.view(U64)) % U64(LONG_PLACES)).astype(np.int64)


def _long_places(batches):
    for batch in batches:
        at = np.unique(places_of(np.asarray(batch.column("a"))))
        word, first = np.unique(at >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(U64), first) if len(at) else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])


def long_places(found: DataFrame) -> np.ndarray:
    """A table of LONG_PLACES booleans, true where the signature of a long list falls; it has the same size for every input."""
    got = found.where("b is null and n = -1").select("a").mapInArrow(_long_places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table_ = np.zeros(LONG_PLACES // 64, "<u8")
    table_[got["word"]] = got["bits"].to_numpy(np.int64).view(U64)
    return np.unpackbits(table_.view(np.uint8), bitorder="little").astype(bool)


def sketch(tokens: np.ndarray) -> bytes:
    """Bits at the places of a set's tokens, two to four times as many bits as tokens."""
    k = max(6, int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(1 << k, bool)
    bits[(mix(tokens.view(U64)) >> U64(64 - k)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def alike(x: bytes, y: bytes, m: int, n: int, percent: int) -> bool:
    """Whether the sketches of sets of m and n tokens leave room for the similarity: a place that only one of them has is a token that the other lacks."""
    a, b = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (x, y))
    size = min(len(a), len(b))
    a, b = (s.reshape(size, -1).any(1) for s in (a, b))
    most = min(m - int((a & ~b).sum()), n - int((b & ~a).sum()))
    return (100 + percent) * most >= percent * (m + n)


def _sketches(batches):
    for batch in batches:
        sets = batch.column("tokens")
        rows, flat = np.asarray(sets.offsets), np.asarray(sets.values)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(rows).astype(np.int64)), pa.array([sketch(flat[a:b]) for a, b in zip(rows, rows[1:])], pa.binary())], names=["node", "n", "sketch"])


def _sketched(batches, percent: int):
    for batch in batches:
        x, y, m, n = (batch.column(c).to_pylist() for c in ("x", "y", "m", "n"))
        yield batch.select(["a", "b"]).filter(pa.array([alike(*z, percent) for z in zip(x, y, m, n)], pa.bool_()))


def _candidates(found: DataFrame, long: DataFrame, percent: int, sketches: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that met and that neither the places of their common tokens nor their sketches rule out; two nodes of long lists are left to others, as their common tokens aren't all counted here."""
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("k"), F.max("i").alias("i"), F.max("j").alias("j"), F.max("m").alias("m"), F.max("n").alias("n"))
    pairs = pairs.where(_enough(*(F.col(c) for c in "kijmn"), percent))
    few = small(long)
    for c in ("a", "b"):
        marked = long.select(F.col("node").alias(c), F.lit(True).alias(f"long_{c}"))
        pairs = pairs.join(F.broadcast(marked) if few else marked, c, "left")
    pairs = pairs.where("long_a is null or long_b is null").select("a", "b", "m", "n")
    if sketches is not None:
        pairs = scratch.stored(pairs)
        of = lambda node, bits: sketches.select(F.col("node").alias(node), F.col("sketch").alias(bits))
        pairs = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "m", "n", "x", "y").mapInArrow(lambda it: _sketched(it, percent), "a long, b long")
    return scratch.stored(pairs.select("a", "b"))


def _long(found: DataFrame, busy: DataFrame | None, scratch: Scratch) -> DataFrame:
    long = found.where("b is null and n = 0").select(F.col("a").alias("node"))
    return scratch.stored((long if busy is None else long.union(busy.select("node"))).distinct())


def connect(
    signed: DataFrame,
    sets_of: Callable[[DataFrame], TokenSets],
    scratch: Scratch,
    percent: int = 80,
    busy: DataFrame | None = None,
    sketches: DataFrame | None = None,
    again: Callable[[DataFrame, np.ndarray], DataFrame] | None = None,
    sigs: int | None = None,
    width: int = 8,
    whole: bool = False,
) -> DataFrame:
    """Verified links (a, b), a table of scratch; their components are those of all links.

    signed: rows (node, sigs, n) as for ``met``; a node may come again with the same signatures. Where n is given, sigs
    are a prefix of the node's tokens in an order that all sets share, by which two sets that are similar meet, and any
    tokens left out of it come last; then pairs that the places of common tokens rule out are dropped. busy: nodes (node)
    that left tokens out. sets_of: the sets of rows (node), or what has the methods of TokenSets. sketches: (node, sketch) of all nodes.
    Nodes of long lists and busy ones are compared by ``prefix_join``; with again they are signed once more before, as
    (node, sigs, n, busy) from rows (node, tokens) and ``long_places``: in an order in which tokens of long lists come
    last, or by more selective signatures. whole: as for ``prefix_join``.
    """
    found = scratch.stored(met(signed, percent, sigs, width))
    scratch.settle()
    long = _long(found, busy, scratch)
    pairs = _candidates(found, long, percent, sketches, scratch)
    scratch.settle()
    need = scratch.stored(long.union(pairs.select("a")).union(pairs.select("b")).distinct())
    sets = sets_of(need)
    scratch.settle()
    if again is not None and not long.isEmpty():
        signed = scratch.stored(again(sets.of(long), long_places(found)))
        found = scratch.stored(met(signed, percent))
        long = _long(found, signed.where("busy"), scratch)
        pairs = pairs.union(_candidates(found, long, percent, None, scratch))
    links = scratch.stored(sets.verified(pairs, percent))
    scratch.settle()
    if not long.isEmpty():
        more = prefix_join(scratch.stored(sets.of(long)), percent, scratch, whole)
        links = links if more is None else links.union(more)
    return scratch.stored(links.distinct())
