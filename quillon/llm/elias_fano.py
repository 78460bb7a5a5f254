"""Elias-Fano sequences, and a trie of n-grams whose levels are such sequences.

A sequence of n non-decreasing numbers below U keeps the low log2(U / n) bits of each as they are and the rest in unary: about
2 + log2(U / n) bits a number. All is one run of bytes that is read in place, from memory or a mapped file; nothing is unpacked.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
CHUNK = 1 << 16
#: Steps of a logarithm (base 10) that a code stands for, and the count that is taken from every seen n-gram.
STEP, DISCOUNT = 1 / 2048, 0.75


def code(p: np.ndarray) -> np.ndarray:
    """Quantised probabilities: 0 for none, else 1 + the nearest number of steps below 1, in 16 bits (down to 1e-31)."""
    out = np.zeros(len(p), np.uint16)
    some = p > 0
    out[some] = 1 + np.minimum(np.rint(-np.log10(p[some]) / STEP), 65534)
    return out


def value(codes: np.ndarray, absent: float = 0.0) -> np.ndarray:
    return np.where(codes == 0, absent, 10.0 ** ((1 - codes.astype(np.float64)) * STEP))


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The 64 bits that begin at each byte."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def _nth_set(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each x."""
    x, r, at = x.copy(), r.astype(np.int64), np.zeros(len(x), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(x & U64((1 << s) - 1)).astype(np.int64)
        go = r >= n
        r -= np.where(go, n, 0)
        x >>= np.where(go, s, 0).astype(U64)
        at += np.where(go, s, 0)
    return at


class Monotone:
    """A non-decreasing sequence. ``find`` and ``at`` work on arrays, a chunk at a time."""

    def __init__(self, image: memoryview, begin: int = 0):
        self.n, self.bits, low, words = (int(v) for v in np.frombuffer(image, np.int64, 4, begin))
        at = begin + 32
        self.low = _lanes(np.frombuffer(image, np.uint8, low, at))
        self.raw_high = np.frombuffer(image, np.uint8, words * 8, at + low)
        self.high, self.runs = self.raw_high.view("<u8").reshape(-1, 8), _lanes(self.raw_high)
        blocks = np.frombuffer(image, np.int64, words // 8, at + low + words * 8)
        self.ones, self.zeros = blocks, np.arange(len(blocks)) * 512 - blocks
        self.end = at + low + words * 8 + len(blocks) * 8

    @staticmethod
    def build(values: np.ndarray, top: int) -> bytes:
        """top: a number that no value reaches."""
        n, v = len(values), values.astype(U64)
        bits = min(max((max(top, 1) // max(n, 1)).bit_length() - 1, 0), 56)
        packed = []
        for a in range(0, n, CHUNK):  # a full chunk fills whole bytes
            planes = (v[a : a + CHUNK, None] >> np.arange(bits, dtype=U64)).astype(np.uint8) & 1
            packed.append(np.packbits(planes.ravel(), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(8, np.uint8)])
        low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)])
        size = n + (max(top, 1) >> bits) + 2
        unary = np.zeros(-(-(size + 64) // 512) * 512, bool)
        unary[(v >> U64(bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(unary, bitorder="little")
        ones = np.bitwise_count(high.view(U64).reshape(-1, 8)).sum(1, dtype=np.int64)
        before = np.cumsum(ones) - ones
        return b"".join([np.array([n, bits, len(low), len(high) // 8], np.int64).tobytes(), low.tobytes(), high.tobytes(), before.tobytes()])

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        before = self.zeros if zeros else self.ones
        block = np.searchsorted(before, k, "right") - 1
        lanes = self.high[block]
        if zeros:
            lanes = ~lanes
        total = np.cumsum(np.bitwise_count(lanes).astype(np.int64), 1)
        r = k - before[block]
        word = (total <= r[:, None]).sum(1)
        row = np.arange(len(k))
        r = r - np.where(word > 0, total[row, word - 1], 0)
        return block * 512 + word * 64 + _nth_set(lanes[row, word], r)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        return (self.low[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        i, out = np.asarray(i, np.int64), np.empty(len(i), U64)
        for a in range(0, len(i), CHUNK):
            j = i[a : a + CHUNK]
            out[a : a + CHUNK] = (self._select(j, False) - j).astype(U64) << U64(self.bits) | self._low(j)
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of the successor (the first value that isn't less) where it is x itself, else -1."""
        x, out = x.astype(U64, copy=False), np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        top = int(self.zeros[-1]) + 512 - int(np.bitwise_count(self.high[-1]).sum())  # zeros in all
        for a in range(0, len(x), CHUNK):
            y = x[a : a + CHUNK]
            inside = np.flatnonzero(y >> U64(self.bits) < U64(top))
            y = y[inside]
            h = (y >> U64(self.bits)).astype(np.int64)
            place = np.zeros(len(h), np.int64)  # of the first bit of the run of ones of bucket h
            later = h > 0
            place[later] = self._select(h[later] - 1, True) + 1
            begin = place - h
            run = (self.runs[place >> 3] >> (place & 7).astype(U64)) & U64((1 << 57) - 1)
            length = np.bitwise_count(run ^ (run + U64(1))).astype(np.int64) - 1
            full = length >= 57
            if full.any():
                length[full] = self._select(h[full], True) - place[full]
            want, low, high = y & U64((1 << self.bits) - 1), begin.copy(), begin + length
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                less = self._low(mid) < want[live]
                low[live[less]] = mid[less] + 1
                high[live[~less]] = mid[~less]
                live = live[low[live] < high[live]]
            hit = low < begin + length
            hit[hit] = self._low(low[hit]) == want[hit]
            out[a + inside[hit]] = low[hit]
        return out


def distinct(columns: list[np.ndarray], top: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers below top, sorted, and each row's place among them."""
    key, span, back = columns[0].astype(np.int64), top, []
    for c in columns[1:]:
        if span * top >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            back.append(seen)
            span = len(seen)
        else:
            back.append(None)
        key, span = key * top + c, span * top
    rows, inverse = np.unique(key, return_inverse=True)
    out = []
    for seen in reversed(back):
        out.append(rows % top)
        rows = rows // top
        if seen is not None:
            rows = seen[rows]
    return [c.astype(np.int32 if top < 1 << 31 else np.int64) for c in (rows, *reversed(out))], inverse.astype(np.int32 if len(rows) < 1 << 31 else np.int64)


def prefixes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of sorted distinct rows, for each length k of a prefix: the place of each row's prefix among the distinct ones."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        out.append((np.cumsum(new) - 1).astype(np.int32 if len(new) < 1 << 31 else np.int64))
    return out


def firsts(places: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    return np.flatnonzero(np.diff(places, prepend=-1))


class Trie:
    """n-grams by levels, each below its context.

    Level k holds context * words + word for each of its nodes, where context is the place of the node above: so one level is one
    monotone sequence, and a successor search in it for a context's word stays within that context's run. Pointers
    (monotone too) give where a context's run begins. A node keeps its quantised discounted probability after its context, and the
    quantised weight that it gives, as a context, to the shorter one; a root keeps its count.
    """

    def __init__(self, image):
        head = np.frombuffer(image, np.int64, 2)
        self.order, at = int(head[0]), 16
        self.words = Monotone(image, at)
        at = self.words.end
        self.levels, self.pointers, self.seen, self.weight = [], [], [], []
        for k in range(self.order):
            self.levels.append(Monotone(image, at))
            at, n = self.levels[-1].end, self.levels[-1].n
            for kept in (self.seen, self.weight):
                kept.append(np.frombuffer(image, np.uint16, n, at))
                at += n * 2 + -n * 2 % 8
            if k < self.order - 1:
                self.pointers.append(Monotone(image, at))
                at = self.pointers[-1].end
        self.totals = Monotone(image, at)
        self.end = self.totals.end

    @classmethod
    def open(cls, path: str) -> Trie:
        """Over a mapped file."""
        return cls(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def build(words: np.ndarray, grams: list[np.ndarray], counts: np.ndarray, known: list[dict[int, int]] | None = None) -> bytes:
        """words: sorted 64-bit names; grams: columns of places in words, rows distinct and sorted; known: of some nodes of each level but the last (by place), the count where this trie has but a part of it."""
        order, place = len(grams), prefixes(grams)
        out = [np.array([order, len(words)], np.int64).tobytes(), Monotone.build(words, int(words[-1]) + 1 if len(words) else 1)]
        total = None
        for k in range(order):
            first = firsts(place[k])
            n = len(first)
            count = np.add.reduceat(counts, first) if n else np.zeros(0, np.int64)
            for i, c in (known[k] if known and k < order - 1 else {}).items():
                count[i] = c
            context = place[k - 1][first] if k else np.zeros(n, np.int32)
            out.append(Monotone.build(context.astype(U64) * U64(max(len(words), 1)) + grams[k][first].astype(U64), max(1, (len(total) if k else 1)) * max(len(words), 1)))
            seen = code((count - DISCOUNT) / total[context]) if k else np.zeros(n, np.uint16)
            weight = np.zeros(n, np.uint16)
            if k < order - 1:
                below = firsts(place[k + 1])
                children = np.bincount(place[k][below], minlength=n)
                weight = code(DISCOUNT * children / count) if n else weight
            for kept in (seen, weight):
                out.append(kept.tobytes() + bytes(-n * 2 % 8))
            if k < order - 1:
                out.append(Monotone.build(np.concatenate([[0], np.cumsum(children)]), int(children.sum()) + 1))
            if not k:
                roots = count
            total = count
        out.append(Monotone.build(np.concatenate([[0], np.cumsum(roots)]), int(roots.sum()) + 1))
        return b"".join(out)

    def child(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of a word (its place in words) below a context's node, -1 where either is missing."""
        out = np.full(len(word), -1, np.int64)
        some = np.flatnonzero((context >= 0) & (word >= 0))
        out[some] = self.levels[level].find(context[some].astype(U64) * U64(max(self.words.n, 1)) + word[some].astype(U64))
        return out

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        """How many nodes of the next level stand below each."""
        return (self.pointers[level].at(node + 1) - self.pointers[level].at(node)).astype(np.int64)

    def count(self, root: np.ndarray) -> np.ndarray:
        """Of roots; 0 for -1."""
        out = np.zeros(len(root), np.int64)
        some = root >= 0
        out[some] = (self.totals.at(root[some] + 1) - self.totals.at(root[some])).astype(np.int64)
        return out
