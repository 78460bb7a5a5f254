"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources gets a token budget at its root. Each node's budget goes to its children by
their weights; a child takes no more than its capacity (its tokens times the most epochs), and what it leaves is dealt
again among its siblings; only what no child of a node can take goes back to that node's own siblings. Each leaf then
takes a prefix of its budget's tokens from seeded epochs: in each epoch all its documents once, in an order of their own.

The order is that of a hash. Where a budget ends inside an epoch, the place is found digit by digit: sums of tokens by
leaf and next two digits name the bin in which it ends, and only that bin is looked into. So no leaf is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small, stored

LEVELS = ("domain", "lang", "source")
SEED = 20
#: Share of all tokens that is the default budget, and the most epochs.
SHARE, EPOCHS = 0.8, 2
#: Documents of a leaf that are put in order at the end of its budget, at most (more only if they share a doc_id).
EDGE = 64
#: Leaves that the driver plans for, at most.
MAX_LEAVES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def domain(source: Column) -> Column:
    """The default first level: four domains, by the number that ends a source's name (none: ``other``)."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS int)")
    return F.coalesce(F.concat(F.lit("domain"), number % 4), F.lit("other"))


def equal_weight(path: tuple[str | None, ...]) -> float:
    return 1.0


def targets(weights: Mapping[tuple, float]) -> Callable[[tuple], float]:
    """Weights by path; 1 where none is given."""
    return lambda path: weights.get(path, 1.0)


def poured(amount: float, children: list, weight: Callable, capacity: Callable) -> dict:
    """The amount dealt by weight, no child above its capacity; what full children leave goes to the others, again by weight. Without any weight above 0 nothing is dealt."""
    given, open_ = dict.fromkeys(children, 0.0), [c for c in children if weight(c) > 0]
    while open_:
        total = sum(weight(c) for c in open_)
        full = [c for c in open_ if capacity(c) <= amount * weight(c) / total]
        if not full:
            return given | {c: amount * weight(c) / total for c in open_}
        for c in full:
            given[c] = capacity(c)
            amount -= given[c]
        open_ = [c for c in open_ if c not in set(full)]
    return given


def budgets(tokens: Mapping[tuple, int], total: float, weight: Callable[[tuple], float] = equal_weight, epochs: int = EPOCHS) -> dict[tuple, int]:
    """Whole tokens of each leaf (a path of names, root first). weight: of a node, by its path; a node without weight gets nothing."""
    children: dict[tuple, list[tuple]] = {}
    capacity: dict[tuple, float] = {}
    for leaf in sorted(tokens, key=lambda p: tuple((x is not None, x or "") for x in p)):
        for k in range(len(leaf)):
            kids = children.setdefault(leaf[:k], [])
            if not kids or kids[-1] != leaf[: k + 1]:
                kids.append(leaf[: k + 1])
    depth = max(map(len, tokens), default=0)
    for leaf, n in tokens.items():
        capacity[leaf] = n * epochs
    # What a node can take: of children without weight, nothing.
    for k in range(depth - 1, -1, -1):
        for node in [c for c in children if len(c) == k]:
            capacity[node] = sum(capacity[c] for c in children[node] if weight(c) > 0)
    share = {(): min(float(total), capacity.get((), 0.0))}
    for k in range(depth):
        for node in [c for c in children if len(c) == k]:
            share |= poured(share[node], children[node], weight, capacity.__getitem__)
    return {leaf: min(int(share[leaf] + 1e-6), tokens[leaf] * epochs) for leaf in tokens}


def _place(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _leaf(docs: DataFrame) -> list[Column]:
    """The leaf of each row, as columns that are named by NAMES."""
    return [domain(docs["source"]).alias("_domain"), docs["lang"].alias("_lang"), docs["source"].alias("_source")]


def _same(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}._{x}").eqNullSafe(F.col(f"{b}._{x}")) for x in LEVELS]


NAMES = [f"_{x}" for x in LEVELS]


def planned(docs: DataFrame, share: float = SHARE, weight: Callable[[tuple], float] = equal_weight, epochs: int = EPOCHS, seed: int = SEED, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their tokens (doc_id, leaf, tokens); for each leaf and epoch that takes something, where its prefix ends (want, n, upto: the first digits of the places in which it ends, null if it takes all; before: tokens before those); and the documents in the end bins that are reached (with start)."""
    spark = docs.sparkSession
    counted = stored(docs.select("doc_id", *_leaf(docs), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")))
    sums = counted.groupBy(*NAMES).agg(F.sum("tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    tokens = {tuple(r[c] for c in NAMES): r["n"] for r in sums}
    plan = budgets(tokens, total_tokens if total_tokens is not None else share * sum(tokens.values()), weight, epochs)
    rows = [(*p, e, min(b - e * tokens[p], tokens[p]), tokens[p]) for p, b in plan.items() for e in range(epochs) if b > e * tokens[p] or (tokens[p] == 0 and e == 0)]
    want = spark.createDataFrame(rows, f"{', '.join(f'{x} string' for x in NAMES)}, epoch int, want long, n long")
    ends = stored(want.where("want < n").withColumns({"upto": F.lit(""), "before": F.lit(0).cast("long"), "inside": F.lit(2**62)}))
    for digits in range(0, 32, 2):
        if not (ends.agg(F.max("inside")).first()[0] or 0) > EDGE:
            break
        # Leaves that are near enough keep their place; the bin of each other is one of at most 256.
        near = _near(counted, ends.where(F.col("inside") > EDGE), seed).withColumn("bin", F.substring("place", digits + 1, 2))
        sums_ = near.groupBy(*NAMES, "epoch", "want", "n", "upto", "before", "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("inside"))
        upto_here = Window.partitionBy(*NAMES, "epoch").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        found = sums_.withColumn("at", F.col("before") + F.coalesce(F.sum("t").over(upto_here), F.lit(0))).where("at < want and at + t >= want").select(*NAMES, "epoch", "want", "n", F.concat("upto", "bin").alias("upto"), F.col("at").alias("before"), "inside")
        ends = stored(found.union(ends.where(F.col("inside") <= EDGE)))
    order = Window.partitionBy(*NAMES, "epoch").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = _near(counted, ends, seed).withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("start < want")
    limits = want.where("want = n").withColumns({"upto": F.lit(None).cast("string"), "before": F.lit(0).cast("long")}).union(ends.drop("inside"))
    return counted, stored(limits), stored(edge.select("doc_id", *NAMES, "epoch", "tokens", "want", "start"))


def _near(counted: DataFrame, ends: DataFrame, seed: int) -> DataFrame:
    """Documents whose place begins with their leaf's digits. ends has a row for each leaf at most: MAX_LEAVES bounds what is broadcast."""
    c, e = counted.alias("c"), F.broadcast(ends).alias("e")
    joined = c.join(e, _same("c", "e")).select("c.doc_id", "c.tokens", *(f"c.{x}" for x in NAMES), "epoch", "want", "n", "upto", "before")
    return joined.withColumn("place", _place(F.col("epoch"), seed)).where(F.col("place").startswith(F.col("upto")))


def _whole(docs: DataFrame, limits: DataFrame, seed: int) -> DataFrame:
    """Documents (with their leaf) that lie before their leaf's end, once for each epoch."""
    c, e = docs.alias("c"), F.broadcast(limits).alias("e")
    joined = c.join(e, _same("c", "e")).select(*(f"c.{x}" for x in docs.columns), "e.epoch", "e.upto")
    place = _place(F.col("epoch"), seed)
    return joined.where(F.col("upto").isNull() | ((place < F.col("upto")) & ~place.startswith(F.col("upto")))).drop("upto")


def prefixes(docs: DataFrame, share: float = SHARE, weight: Callable[[tuple], float] = equal_weight, epochs: int = EPOCHS, seed: int = SEED, total_tokens: int | None = None) -> DataFrame:
    """One row for each document and epoch that is taken: doc_id, domain, lang, source, epoch, tokens, taken.

    docs: doc_id, text, lang, source. Tokens are words of the whole text, null counts as empty. The budget is
    total_tokens, or that share of all tokens. A leaf's last document in order may be taken in part (taken < tokens); a
    document without tokens is taken where the prefix reaches its place. Null languages and sources are leaves of their
    own, rows with a null or repeated doc_id are documents of their own. Other columns are not read.
    """
    counted, limits, edge = planned(docs, share, weight, epochs, seed, total_tokens)
    leaf = [F.col(f"_{x}").alias(x) for x in LEVELS]
    inside = _whole(counted, limits, seed).select("doc_id", *leaf, "epoch", "tokens", F.col("tokens").alias("taken"))
    return inside.union(edge.select("doc_id", *leaf, "epoch", "tokens", F.least("tokens", F.col("want") - F.col("start")).alias("taken")))


def selected(docs: DataFrame, share: float = SHARE, weight: Callable[[tuple], float] = equal_weight, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, of which one epoch's prefixes take a part or all; the last document of a leaf stays whole.

    Rows of a leaf that share a doc_id, or have none, stay or go together at the end of its budget.
    """
    _, limits, edge = planned(docs, share, weight, 1, seed)
    # The row's own columns travel in one, so that no name of theirs can clash.
    rows = docs.select("doc_id", *_leaf(docs), F.struct(*docs.columns).alias("row"))
    inside = _whole(rows, limits, seed).select("row.*")
    last = stored(edge.select("doc_id", *NAMES).distinct())
    e = (F.broadcast(last) if small(last) else last).alias("e")
    r = rows.alias("r")
    return inside.union(r.join(e, [*_same("r", "e"), F.col("r.doc_id").eqNullSafe(F.col("e.doc_id"))], "left_semi").select("row.*"))
