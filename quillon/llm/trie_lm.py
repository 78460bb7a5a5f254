"""Language-model scores from n-gram tries in shards.

The model is an interpolated one with absolute discounting: p(w | h) = max(c(hw) - D, 0) / c(h) + D t(h) / c(h) p(w | h'),
t(h) being the number of words seen after h and h' being h without its first word; a context never seen passes to h'
whole. It ends at (c(w) + 1) / (N + V + 1), where V counts the distinct training tokens and one more stands for all
unknown ones. So the probabilities after any context sum to one (but for rounding of the codes).

- Texts become blocks: their words' distinct 64-bit names and, in place of words, numbers of these. A block is written once.
- Every position begins a window of ``order`` tokens; a text begins with a mark and ends with one. Windows, their distinct counts
  of training texts with them, go to the shard of their first word, so a shard has all that its nodes need. A first word
  that many windows share (2 in a shard's worth) is dealt by two words, such a pair by three.
- A shard builds its trie (``elias_fano.Trie``) and looks up all distinct windows that blocks asked for. It answers in codes; a
  block puts the answers of all shards together and sums its texts' logarithms.

Work and memory of a task are bounded by a block and a shard, whatever the corpus. What comes to the driver: words and pairs that are
dealt further (at most 4 for each shard), and two numbers a shard. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, hash_spans, mix, slices, tidy, words_of
from .elias_fano import DISCOUNT, Trie, code, distinct, firsts, prefixes, value
from .scratch import Scratch

ORDER = 3
#: Text bytes of a block, and windows of a shard.
BLOCK, SHARD = 8 << 20, 3 << 19
#: Names that messages give by number: of the commonest words of a few blocks. This only shortens messages.
COMMON, COMMON_BLOCKS = 1 << 16, 16
BEGIN, END, PAD = U64(1), U64(2), U64(3)

BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("train", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("words", pa.int64()), ("tokens", pa.binary()), ("size", pa.int64()), ("learned", pa.int64())])
BLOCKS_DDL = "block long, doc_id array<long>, held_out array<boolean>, train array<boolean>, n array<long>, words long, tokens binary, size long, learned long"


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays, each turned so that the bytes of one place stand together."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays if len(a))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


class _Unpack:
    def __init__(self, packed):
        raw = memoryview(packed)
        self.raw, self.at = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd"), 0

    def take(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        out = np.frombuffer(self.raw, np.uint8, size, self.at)
        self.at += size
        return np.ascontiguousarray(out.reshape(-1, n).T).view(kind).ravel() if n else np.empty(0, kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """The first number, then differences; they wrap around."""
    return np.diff(x, prepend=x.dtype.type(0))


def _named(names: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Sorted names: which are common, these by their numbers, and the others."""
    is_common = _among(names, common)
    return [np.packbits(is_common), _steps(np.searchsorted(common, names[is_common]).astype(np.uint32)), _steps(names[~is_common])]


def _names(part: _Unpack, n: int, common: np.ndarray) -> np.ndarray:
    is_common = np.unpackbits(part.take(-(-n // 8), np.uint8), count=n).astype(bool)
    out, k = np.empty(n, U64), int(is_common.sum())
    out[is_common] = common[np.cumsum(part.take(k, np.uint32))]
    out[~is_common] = np.cumsum(part.take(n - k, U64), dtype=U64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for k, batch in enumerate(slices(batches, limit=limit)):
        w = words_of(batch.column("text"), lower=True)
        names, token = np.unique(np.concatenate([hash_spans(w.data, w.starts, w.ends), [END]]), return_inverse=True)
        n, end = w.counts + 1, token[-1]
        tokens = np.insert(token[:-1], w.rows[1:], end).astype(np.uint32)
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), column if isinstance(column, pa.Array) else pa.array(column))
        train = np.asarray(batch.column("train").fill_null(False).to_numpy(zero_copy_only=False), bool)
        yield pa.RecordBatch.from_arrays([pa.array([part + k]), one(batch.column("doc_id")), one(batch.column("held_out")), one(train), one(n), pa.array([len(names)]), pa.array([_pack(_steps(names), tokens)], pa.binary()), pa.array([int(n.sum() + len(n))]), pa.array([int(n[train].sum())])], schema=BLOCKS)


class Block:
    """Texts as tokens, and their windows."""

    def __init__(self, row: dict, order: int):
        self.n = np.array(row["n"], np.int64)
        self.train = np.array(row["train"], bool)
        packed = _Unpack(row["tokens"])
        names, tokens = np.cumsum(packed.take(row["words"], U64), dtype=U64), packed.take(int(self.n.sum()), np.uint32)
        # The marks are names like others.
        self.names = np.unique(np.concatenate([names, [BEGIN, END, PAD]]))
        at = np.searchsorted(self.names, names).astype(np.int32)
        begin, pad = np.searchsorted(self.names, [BEGIN, PAD])
        self.rows = np.concatenate([[0], np.cumsum(self.n + 1)])  # a text's begin mark
        self.text = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n + 1)
        first = np.zeros(len(self.text), bool)
        first[self.rows[:-1]] = True
        self.sequence = np.full(len(self.text), begin, np.int32)
        self.sequence[~first] = at[tokens]
        self.columns = [self.sequence]
        for k in range(1, order):
            c = np.full(len(self.text), pad, np.int32)
            same = self.text[k:] == self.text[:-k]
            c[: len(same)][same] = self.sequence[k:][same]
            self.columns.append(c)

    def hashes(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Names of the prefixes of each length."""
        out = [mix(self.names)[columns[0]]]
        for c in columns[1:]:
            out.append(mix(out[-1] + self.names[c] * U64(0x9E3779B97F4A7C15) + U64(1)))
        return out

    def windows(self) -> None:
        """Distinct windows, sorted, how often training texts have them, and which one begins at each position."""
        self.grams, self.window = distinct(self.columns, len(self.names))
        self.learned = np.bincount(self.window[self.train[self.text]], minlength=len(self.grams[0]))

    def shards(self, hot: list[np.ndarray], shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """The windows of each shard."""
        names = self.hashes(self.grams)
        route, deeper = names[0], np.ones(len(names[0]), bool)
        for k, keys in enumerate(hot):
            deeper = deeper & _among(names[k], keys)
            route = np.where(deeper, names[k + 1], route)
        shard = ((mix(route) >> U64(32)) * U64(shards) >> U64(32)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = firsts(shard[order])
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            yield int(shard[order[a]]), order[a:b]


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which are among sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _block_rows(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            row = {k: v.values.to_numpy(zero_copy_only=False) if k in ("n", "train") else v.as_buffer() if k == "tokens" else v.as_py() if k in ("block", "words") else v for k, v in row.items()}
            yield row, Block(row, order)


def _prefix_counts(batches, order: int, hot: list[np.ndarray], keys: np.ndarray | None, share: float):
    """Of prefixes one longer than hot has levels, whose own prefixes are hot: the count of those that have the share of a block (keys none), or the training count of keys."""
    for _, block in _block_rows(batches, order):
        names = block.hashes(block.columns[: len(hot) + 1])
        inside = np.ones(len(block.sequence), bool)
        for k, h in enumerate(hot):
            inside &= _among(names[k], h)
        if keys is not None:
            inside &= block.train[block.text] & _among(names[-1], keys)
        found, n = np.unique(names[-1][inside], return_counts=True)
        some = n >= (share * len(block.sequence) if keys is None else 1)
        yield pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(n[some])], ["name", "n"])


def _hot(blocks: DataFrame, order: int, size: int, shards: int) -> list[dict[int, int]]:
    """For each level but the last the prefixes that are dealt further, with their training counts: all with the 2 * shards-th part of all windows are among them.

    One with that share has half of it in some blocks, and blocks where it has less add up to at most half its count: so its
    counts in blocks where it has half the share come to half the share of all, at least.
    """
    hot: list[dict[int, int]] = []
    share = 1 / (4 * shards)
    for _ in range(order - 1):
        keys = [np.array(sorted(h), U64) for h in hot]
        counted = blocks.mapInArrow(lambda it, k=keys: _prefix_counts(it, order, k, None, share), "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
        names = np.sort(np.array([r["name"] for r in counted.where(F.col("n") >= share * size).collect()], np.int64).view(U64))
        if not len(names):
            break
        exact = blocks.mapInArrow(lambda it, k=keys, s=names: _prefix_counts(it, order, k, s, 0), "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
        hot.append({int(n): 0 for n in names} | {int(np.int64(r["name"]).view(U64)): r["n"] for r in exact.collect()})
    return hot


def _asked(batches, order: int, hot: list[np.ndarray], shards: int, common: np.ndarray):
    """A block's windows for each shard."""
    for row, block in _block_rows(batches, order):
        block.windows()
        out = []
        for shard, mine in block.shards(hot, shards):
            columns = [g[mine] for g in block.grams]
            used = np.unique(np.concatenate(columns))
            at = [np.searchsorted(used, c).astype(np.uint32) for c in columns]
            # Windows are sorted: the first word's steps, and the second word's after the same first.
            steps = _steps(at[0])
            if order > 1:
                at[1] = np.where(steps == 0, _steps(at[1]), at[1])
            out.append((shard, len(used), len(mine), _pack(*_named(block.names[used], common), steps, *at[1:], block.learned[mine].astype(np.uint32))))
        shard, words, n, packed = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([row["block"]] * len(out)), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["shard", "block", "words", "windows", "packed"])


ANSWERS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("packed", pa.binary()), ("level", pa.int32()), ("name", pa.int64()), ("n", pa.int64())])
ANSWERS_DDL = "block long, shard int, packed binary, level int, name long, n long"


def _shard(asked: pa.Table, order: int, hot: list[dict[int, int]], common: np.ndarray, images: bool = False) -> pa.Table:
    """Builds a shard's trie and answers each block. Rows without a block give, by level, words in the trie (level -1), and the nodes below hot prefixes."""
    shard, packed = asked.column("shard")[0].as_py(), asked.column("packed")
    words, windows = asked.column("words").to_numpy(), asked.column("windows").to_numpy()
    names, back = np.unique(np.concatenate([_names(_Unpack(raw.as_buffer()), w, common) for raw, w in zip(packed, words)]), return_inverse=True)
    back = back.astype(np.int32)
    columns, counts = [np.empty(windows.sum(), np.int32) for _ in range(order)], np.empty(windows.sum(), np.uint32)
    base = at = 0
    for raw, w, n in zip(packed, words, windows):
        part, own = _Unpack(raw.as_buffer()), back[base : base + w]
        _names(part, w, common)
        for k in range(order):
            c = part.take(n, np.uint32)
            if k == 0:
                begin = firsts(np.cumsum(c, dtype=np.int64))
                c = np.cumsum(c, dtype=np.uint32)
            elif k == 1:  # steps begin anew with each first word
                total = np.cumsum(c, dtype=np.uint32)
                c = total - np.repeat(total[begin] - c[begin], np.diff(begin, append=n))
            columns[k][at : at + n] = own[c]
        counts[at : at + n] = part.take(n, np.uint32)
        base, at = base + w, at + n
    del back
    grams, window = distinct(columns, len(names))
    del columns
    learned = np.bincount(window, counts, len(grams[0])).astype(np.int64)
    del counts
    keys = [np.array(sorted(h), U64) for h in hot]
    seen = learned > 0
    own = [g[seen] for g in grams]
    used = np.zeros(len(names), bool)
    for g in own:
        used[g] = True
    at = (np.cumsum(used) - 1).astype(np.int32)
    own = [at[g] for g in own]
    trie_words = names[used]
    known, stats = [], []
    place = prefixes(own)
    first = firsts(place[0])
    h = mix(trie_words)[own[0][first]]  # of the level's nodes
    inside = _among(h, keys[0]) if keys else np.zeros(len(h), bool)
    stats.append((-1, 0, int((~inside & (trie_words[own[0][first]] != BEGIN)).sum())))
    for k in range(order - 1):
        known.append({int(i): hot[k][int(h[i])] for i in np.flatnonzero(inside)})
        below = firsts(place[k + 1])
        context = place[k][below]
        lower = mix(h[context] + trie_words[own[k + 1][below]] * U64(0x9E3779B97F4A7C15) + U64(1))
        deeper = inside[context] & _among(lower, keys[k + 1]) if k + 1 < len(keys) else np.zeros(len(lower), bool)
        # Nodes below a hot one; those that are hot themselves stand in several shards and are counted elsewhere.
        for name, n in zip(*np.unique(h[context[inside[context] & ~deeper]], return_counts=True)):
            stats.append((k, int(name.view(np.int64)), int(n)))
        h, inside = lower, deeper
    del place, h, inside
    image = Trie.build(trie_words, own, learned[seen], known)
    del own, learned
    trie = Trie(np.frombuffer(image, np.uint8))
    # Every distinct window that was asked for, level by level.
    place, nodes = prefixes(grams), None
    word = trie.words.find(names)
    answers = []
    for k in range(order):
        first = firsts(place[k])
        context = nodes[place[k - 1][first]] if k else np.zeros(len(first), np.int64)
        nodes = trie.child(k, context, word[grams[k][first]])
        got = lambda kept: np.where(nodes >= 0, kept[np.maximum(nodes, 0)], 0).astype(np.uint16) if len(kept) else np.zeros(len(nodes), np.uint16)  # noqa: E731, B023
        answers.append((trie.count(nodes) if not k else got(trie.seen[k]), got(trie.weight[k])))
    out, at = [], 0
    for block, n in zip(asked.column("block").to_pylist(), windows):
        mine = window[at : at + n]
        at += n
        parts = []
        for k in range(order):
            p = place[k][mine]
            node = p[firsts(p)]
            parts += [a[node] for a in answers[k][: 1 if k == order - 1 else 2]]
        out.append((block, shard, _pack(*parts), None, None, None))
    out += [(None, shard, None, *s) for s in stats]
    tidy()
    if images:
        out.append((None, shard, image, None, None, len(trie_words)))
    return pa.Table.from_arrays([pa.array(c, ANSWERS.field(i).type) for i, c in enumerate(zip(*out))], schema=ANSWERS)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(blocks: pa.Table, answers: pa.Table, order: int, shards: int, hot: list[dict[int, int]], weights: list[dict[int, float]], total: int, distinct_words: int) -> pa.Table:
    replies = dict(zip(answers.column("shard").to_pylist(), answers.column("packed")))
    out = []
    for row, block in _block_rows(blocks.to_batches(), order):
        block.windows()
        place = prefixes(block.grams)
        sizes = [int(p[-1]) + 1 if len(p) else 0 for p in place]
        count, seen, weight = np.zeros(sizes[0], np.int64), [None] + [np.zeros(s) for s in sizes[1:]], [np.ones(s) for s in sizes[:-1]]
        for shard, mine in block.shards([np.array(sorted(h), U64) for h in hot], shards):
            reply = _Unpack(replies[shard].as_buffer())
            for k in range(order):
                p = place[k][mine]
                node = p[firsts(p)]
                if k:
                    seen[k][node] = value(reply.take(len(node), np.uint16))
                else:
                    count[node] = reply.take(len(node), np.int64)
                if k < order - 1:
                    weight[k][node] = value(reply.take(len(node), np.uint16), 1.0)
        for k, (h, g) in enumerate(zip(hot, weights)):
            first = firsts(place[k])
            names = block.hashes([c[first] for c in block.grams[: k + 1]])
            inside = np.ones(len(first), bool)
            for j in range(k + 1):
                inside &= _among(names[j], np.array(sorted(hot[j]), U64))
            for i in np.flatnonzero(inside):
                name = int(names[-1][i])
                weight[k][i] = g[name]
                if not k:
                    count[i] = h[name]
        # Position by position: the probability of a token after ever longer contexts.
        at = block.window
        own = count[place[0][at]]
        p = base = (own + 1) / (total + distinct_words + 1)
        for k in range(1, order):
            inside = np.flatnonzero(block.text[k:] == block.text[:-k]) + k  # the text began k tokens before, or earlier
            gram, context = place[k][at[inside - k]], place[k - 1][at[inside - k]]
            q = p.copy()
            q[inside] = seen[k][gram] + weight[k - 1][context] * p[inside]
            p = q
        token = np.ones(len(at), bool)
        token[block.rows[:-1]] = False
        sums = lambda x: np.add.reduceat(np.where(token, x, 0), block.rows[:-1]) if len(block.n) else np.zeros(0)
        out.append(pa.RecordBatch.from_arrays([row["doc_id"].values, row["held_out"].values, pa.array(block.n), pa.array(sums(own > 0).astype(np.int64)), pa.array(np.full(len(block.n), total)), pa.array(sums(np.log10(base))), pa.array(sums(np.log10(p)))], schema=SCORES))
    return pa.Table.from_batches(out, SCORES)


def blocks_of(docs: DataFrame, held_out, limit: int = BLOCK) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return rows.withColumn("train", ~F.coalesce("held_out", F.lit(True))).mapInArrow(lambda it: _blocks(it, limit), BLOCKS_DDL)


def default_split():
    """Documents whose crc32(doc_id as text) mod 7 is 2 are held out; null for rows without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def _word_counts(batches):
    for _, block in _block_rows(batches, 1):
        n = np.bincount(block.sequence, minlength=len(block.names))
        some = np.flatnonzero(n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(block.names[some].view(np.int64)), pa.array(n[some])], ["name", "n"])


def _common(blocks: DataFrame) -> np.ndarray:
    some = [r["block"] for r in blocks.select("block").orderBy("block").limit(COMMON_BLOCKS).collect()]
    counts = blocks.where(F.col("block").isin(some)).mapInArrow(_word_counts, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["name"] for r in counts.orderBy(F.desc("n"), "name").limit(COMMON).select("name").collect()], np.int64).view(U64))


def _asked_of(blocks: DataFrame, order: int, size: int, per_shard: int) -> tuple[DataFrame, int, list[dict[int, int]], np.ndarray]:
    shards = max(1, math.ceil(size / per_shard))
    hot = _hot(blocks, order, size, shards) if shards > 1 else []
    keys = [np.array(sorted(h), U64) for h in hot]
    common = _common(blocks)
    return blocks.mapInArrow(lambda it: _asked(it, order, keys, shards, common), "shard int, block long, words long, windows long, packed binary"), shards, hot, common


def tries(docs: DataFrame, order: int = ORDER, held_out=None, per_shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The model itself: one row (shard, words, image) for each shard, image being the bytes that ``elias_fano.Trie`` reads in place (or, written to a file, maps)."""
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.stored(blocks_of(docs, default_split() if held_out is None else held_out, block))
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    asked, _, hot, common = _asked_of(blocks, order, size, per_shard)
    made = asked.groupBy("shard").applyInArrow(lambda t: _shard(t, order, hot, common, True), ANSWERS_DDL)
    return made.where("block is null and packed is not null").select("shard", F.col("n").alias("words"), F.col("packed").alias("image"))


def scored(docs: DataFrame, order: int = ORDER, held_out=None, per_shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose ``held_out`` (a boolean column; default: ``default_split``) is false; where it is null, as for
    rows without an id, they are scored only. A null or empty text has one token, its end. Equal texts and repeated ids get a
    row each and count each time. Without training texts every score is that of an unknown token, 0. A text longer
    than a block is a block of its own. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.stored(blocks_of(docs, default_split() if held_out is None else held_out, block))
    size, total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    asked, shards, hot, common = _asked_of(blocks, order, size, per_shard)
    answers = scratch.settled(asked.groupBy("shard").applyInArrow(lambda t: _shard(t, order, hot, common), ANSWERS_DDL))
    stats = {(r["level"], r["name"]): r["n"] for r in answers.where("block is null").groupBy("level", "name").agg(F.sum("n").alias("n")).collect()}
    begin = int(mix(np.array([BEGIN]))[0])
    distinct_words = stats.get((-1, 0), 0) + sum(c > 0 and name != begin for name, c in (hot[0] if hot else {}).items())
    weights = _hot_weights(blocks, order, hot, stats)
    replies = answers.where("block is not null").select("block", "shard", "packed")
    done = scratch.settled(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda left, right: _scores(left, right, order, shards, hot, weights, total, distinct_words), SCORES_DDL))
    scratch.keep(done)
    scratch.clear()
    return done


def _hot_children(batches, order: int, level: int, above: np.ndarray, below: np.ndarray):
    """Pairs of a hot prefix and a hot one a word longer."""
    for _, block in _block_rows(batches, order):
        names = block.hashes(block.columns[: level + 2])
        inside = _among(names[level], above) & _among(names[level + 1], below) & block.train[block.text]
        pairs = np.unique(np.stack([names[level][inside], names[level + 1][inside]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])


def _hot_weights(blocks: DataFrame, order: int, hot: list[dict[int, int]], stats: dict) -> list[dict[int, float]]:
    """What hot contexts give to the shorter ones: nodes below them are counted by the shards, those that are hot themselves here."""
    out = []
    for k, level in enumerate(hot):
        more: dict[int, int] = {}
        if k + 1 < len(hot):
            above, below = np.array(sorted(level), U64), np.array(sorted(hot[k + 1]), U64)
            for r in blocks.mapInArrow(lambda it, k=k, a=above, b=below: _hot_children(it, order, k, a, b), "a long, b long").distinct().groupBy("a").count().collect():
                more[r["a"]] = r["count"]
        out.append({})
        for name, c in level.items():
            key = int(np.array([name], U64).view(np.int64)[0])
            t = stats.get((k, key), 0) + more.get(key, 0)
            out[k][name] = float(value(code(np.array([DISCOUNT * t / c])), 1.0)[0]) if c else 1.0
    return out
