"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours for each seed document, which greedily fill its window.

Documents with the same least word hash lie in the same cell. A cell over SHARD_BYTES of text is split by the least hash
of another hash function, and so on; so a shard fits one task, whatever one source holds, and its documents are alike at
every size of the corpus. Only copies so near that they agree in all LEVELS least hashes are dealt out. Small neighbouring
cells share a shard. Counts of documents by term and the mean length are those of the whole corpus; each shard is indexed
and packed by itself. A neighbour that doesn't fit is cut: its head fills the window, its rest is the next seed. So all
windows of a shard are full but its last.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, Words, hash_spans, lists, lower, mix, per_row, slices, table, tidy, words_of
from .scratch import small_batches, stored

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
LOCALITY = 4096
SHARD_BYTES = 4 << 20
#: Least hashes of a document, and cells into which a large cell is split for each shard that it would fill.
LEVELS, SPLIT = 8, 16
#: BM25's constants.
K1, B = 1.2, 0.75
#: Pieces of words that a worker remembers (as many as twice, some 200 bytes each), places in its table of words (18 bytes each), and ids of such words.
REMEMBERED, PLACES, MOST_IDS = 200_000, 1 << 20, 1 << 22


def lower_hashes(w: Words) -> np.ndarray:
    """Of each word, A-Z lower-cased."""
    return hash_spans(lower(w.data), w.starts, w.ends)


def locality(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's least word hashes by LEVELS hash functions (rows x LEVELS), and its bytes. h: lower_hashes of its words, which odd factors permute."""
    some = w.counts > 0
    out = np.zeros((len(some), LEVELS), np.int64)
    if len(h):
        for k in range(LEVELS):
            x = h * U64(k * 0x9E3779B97F4A7C15 * 2 + 1 & 0xFFFFFFFFFFFFFFFF)
            out[some, k] = (mix(np.minimum.reduceat(x, w.rows[:-1][some])) >> U64(1)).astype(np.int64)
    return out, per_row(w.solid, w.offsets) + 1


class Cells:
    """A tree of cells: the first LOCALITY are of the first least hash; a split cell's are ``count`` from ``base`` on, by the next one."""

    def __init__(self):
        self.base, self.count, self.sizes = np.full(LOCALITY, -1), np.ones(LOCALITY, np.int64), np.zeros(LOCALITY, np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The cell of each row, the smallest there is by now."""
        cell = hashes[:, 0] % LOCALITY
        for k in range(1, LEVELS):
            split = np.flatnonzero(self.base[cell] >= 0)
            cell[split] = self.base[cell[split]] + hashes[split, k] % self.count[cell[split]]
        return cell

    def split(self, first: int, shard_bytes: int) -> bool:
        """Splits the large ones of the cells from ``first`` on; whether there are any."""
        large = first + np.flatnonzero(self.sizes[first:] > shard_bytes)
        if not len(large):
            return False
        n = SPLIT * -(-self.sizes[large] // shard_bytes)
        self.count[large] = n
        self.base[large] = len(self.base) + np.concatenate([[0], np.cumsum(n)])[:-1]
        new = int(n.sum())
        self.base, self.count, self.sizes = np.append(self.base, np.full(new, -1)), np.append(self.count, np.ones(new, np.int64)), np.append(self.sizes, np.zeros(new, np.int64))
        return True

    def leaves(self) -> np.ndarray:
        """Cells that aren't split, those of one split together."""
        out, stack = [], list(range(LOCALITY - 1, -1, -1))
        while stack:
            i = stack.pop()
            if self.base[i] < 0:
                out.append(i)
            else:
                stack += range(self.base[i] + self.count[i] - 1, self.base[i] - 1, -1)
        return np.array(out, np.int64)


def least_hashes(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), LEVELS)


SIZES = pa.schema([("cell", pa.int64()), ("bytes", pa.int64())])


def _sizes(batches, cells: Cells, first: int):
    n = np.zeros(len(cells.base), np.int64)
    for batch in batches:
        np.add.at(n, cells.of(least_hashes(batch.column("hashes"))), np.asarray(batch.column("bytes")))
    seen = first + np.flatnonzero(n[first:])
    yield table({"cell": seen, "bytes": n[seen]}, SIZES)


def cells_of(encoded: DataFrame, shard_bytes: int) -> Cells:
    """Cells of at most shard_bytes, as far as least hashes tell documents apart."""
    cells, first = Cells(), 0
    for k in range(LEVELS):
        plan = encoded.sparkSession.sparkContext.broadcast(cells)
        got = encoded.select("hashes", "bytes").mapInArrow(lambda it: _sizes(it, plan.value, first), "cell long, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes")).toPandas()  # noqa: B023
        cells.sizes[got["cell"]] = got["bytes"]
        before = len(cells.base)
        if k == LEVELS - 1 or not cells.split(first, shard_bytes):
            return cells
        first = before
    return cells


DF = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("tokens", pa.int64())])


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each document, how often each occurs, and each document's first, one more than documents."""
    size = np.array([len(d) for d in docs], np.int64)
    key = np.sort(np.repeat(np.arange(len(docs), dtype=U64), size) << U64(32) | np.concatenate([np.empty(0, "<u4"), *docs]).astype(U64))
    first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return (key[first] & U64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(first, len(key))), np.searchsorted(key[first] >> U64(32), np.arange(len(docs) + 1, dtype=U64))


def _terms(batches):
    """Documents by term, and in the row of term -1 all documents and tokens."""
    n, docs, tokens = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            here = [widened(x) for x in batch.column("ids").slice(at, 1000).to_pylist()]
            docs, tokens = docs + len(here), tokens + sum(map(len, here))
            more = np.bincount(counted(here)[0])
            n, more = (np.append(x, np.zeros(max(len(n), len(more)) - len(x), np.int64)) for x in (n, more))
            n = n + more
    tidy()
    seen = np.flatnonzero(n)
    yield table({"term": np.append(seen, -1), "df": np.append(n[seen], docs), "tokens": np.append(np.zeros(len(seen), np.int64), tokens)}, DF)


def corpus_terms(encoded: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length, and documents by term id; as many numbers as the vocabulary has come to the driver."""
    got = encoded.select("ids").mapInArrow(_terms, "term long, df long, tokens long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")).toPandas()
    whole, terms = got[got["term"] < 0], got[got["term"] >= 0]
    n = int(whole["df"].sum())
    df = np.zeros(int(terms["term"].max()) + 1 if len(terms) else 0, np.int64)
    df[terms["term"]] = terms["df"]
    return n, int(whole["tokens"].sum()) / max(n, 1), df


def shards(sizes: np.ndarray, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each bucket: small neighbours share one, a large bucket has several."""
    first, number = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    shard, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > shard_bytes:
            shard, held = shard + 1, 0
        first[i] = shard
        if size > shard_bytes:
            number[i] = -(-size // shard_bytes)
            shard, held = shard + int(number[i]), 0
        else:
            held += size
    return first, number


#: Printable ASCII without the apostrophe, and the letters of Latin-1: on words of these alone the tokenizer's normaliser
#: lower-cases and nothing else, and its splitter cuts runs of letters, single digits and runs of other characters.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: itself if it is printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by words: the tokenizer drops white space and never joins across it, so equal words have equal ids everywhere.

    Ids of words are remembered in a table of fixed size, by two places of their hash; a word is known again by 96 bits.
    New plain words go to the tokenizer's model piece by piece, which is several times faster than the whole tokenizer.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.pieces, self.before = {}, {}  # the later and the earlier ones; what is met again becomes a later one
        self.key, self.check = np.zeros(PLACES, U64), np.zeros(PLACES, np.uint32)
        self.begin, self.size = np.zeros(PLACES, np.uint32), np.zeros(PLACES, np.uint16)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def piece(self, text: str) -> bytes:
        if (ids := self.pieces.get(text)) is None:
            if (ids := self.before.get(text)) is None:
                written = text if text.isascii() else text.translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
            self.pieces[text] = ids
        return ids

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, not remembered."""
        out: list[bytes | None] = [None] * len(words)
        other = []
        known, piece, plain = self.pieces, self.piece, PLAIN.fullmatch
        # Lower-cased all at once; of plain words each letter's lower case is its own.
        for i, (x, y) in enumerate(zip(words, "\n".join(words).lower().split("\n"))):
            if x.isascii() and x.isalpha():  # one piece
                out[i] = known.get(y) or piece(y)
            elif plain(x) and not ("<" in x and any(t in x for t in self.special)):
                if y.isalpha():
                    out[i] = known.get(y) or piece(y)
                else:
                    out[i] = b"".join([known.get(p) or piece(p) for p in PIECE.findall(y)])
            else:
                other.append(i)
        for at in range(0, len(other), 10_000):
            part = other[at : at + 10_000]
            for i, e in zip(part, self.tokenizer.encode_batch([words[i] for i in part], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def learned(self, w: Words, new: np.ndarray, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ids and number of ids of words that aren't known yet; they are put in the table."""
        _, first, which = np.unique(h[new], return_index=True, return_inverse=True)
        one = new[first]
        ids = self.words(written(w.data, w.starts[one], w.ends[one]))
        size = np.array([len(x) // 4 for x in ids], np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = self.used + np.concatenate([[0], np.cumsum(size)])[:-1]
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        place, second = places(h[one])
        place = np.where((self.key[place] == 0) | (self.key[second] != 0), place, second)
        short = np.flatnonzero(size < 1 << 16)  # a longer one is made anew each time
        for own, x in ((self.key, h[one]), (self.check, check[one]), (self.begin, begin), (self.size, size)):
            own[place[short]] = x[short]
        # Words that fell on one place overwrote each other in one order for all columns.
        return begin[which], size[which]

    def texts(self, w: Words, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the first of each text, one more than texts; without the closing ids. lower: lower_hashes of the words."""
        if len(self.pieces) > REMEMBERED:
            self.before, self.pieces = self.pieces, {}
        if self.used > MOST_IDS:
            self.forget()
        h, check = hash_spans(w.data, w.starts, w.ends, 11), lower.astype(np.uint32)
        place, second = places(h)
        other = np.flatnonzero((self.key[place] != h) | (self.check[place] != check))
        place[other] = second[other]
        new = other[(self.key[place[other]] != h[other]) | (self.check[place[other]] != check[other])]
        begin, size = self.begin[place].astype(np.int64), self.size[place].astype(np.int64)
        if len(new):
            begin[new], size[new] = self.learned(w, new, h, check)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])] if total[-1] else np.empty(0, "<u4")
        return out, total[w.rows]


def written(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """Words of UTF-8 bytes, none of which holds white space; they are decoded all at once."""
    if not len(starts):
        return []
    size = ends - starts + 1
    last = np.cumsum(size)
    raw = np.append(data, np.uint8(0))[np.repeat(starts - last + size, size) + np.arange(last[-1])]
    raw[last - 1] = 10
    return raw[:-1].tobytes().decode().split("\n")


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % U64(PLACES)).astype(np.int64), (h >> U64(40)).astype(np.int64) % PLACES


#: Marks of packed ids, and the closing id.
NARROW, WIDE = b"s", b"l"
NARROW_END, WIDE_END = np.array([END_ID], "<u2").tobytes(), np.array([END_ID], "<u4").tobytes()
ENCODED = pa.schema([("doc_id", pa.int64()), ("bytes", pa.int64()), ("hashes", pa.list_(pa.int64())), ("ids", pa.binary())])
DEALT = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def remembered(definition: str) -> Encoder:
    """The encoder of this worker process: one that is used again still has what it learned. Only one is held."""
    held = sys.modules.setdefault("_quillon_encoder", ModuleType("_quillon_encoder"))
    if getattr(held, "definition", None) != definition:
        held.definition, held.encoder = definition, Encoder(definition)
    return held.encoder


def _encode(batches, definition: str):
    encoder = remembered(definition)
    for batch in slices(batches):
        w = words_of(batch.column("text"))
        h = lower_hashes(w)
        hashes, size = locality(w, h)
        ids, rows = encoder.texts(w, h)
        narrow_, wide = ids.astype("<u2"), np.maximum.reduceat(np.append(ids, 0), rows[:-1]) >= 65536 if len(ids) else np.zeros(len(size), bool)
        # Ids of the vocabulary need 16 bits; wider ones keep 32.
        made = [WIDE + ids[a:b].tobytes() + WIDE_END if x else NARROW + narrow_[a:b].tobytes() + NARROW_END for a, b, x in zip(rows.tolist(), rows[1:].tolist(), wide.tolist())]
        yield table({"doc_id": batch.column("doc_id"), "bytes": size.astype(np.int64), "hashes": lists(hashes.ravel(), np.arange(len(hashes) + 1) * LEVELS, pa.int64()), "ids": pa.array(made, pa.binary())}, ENCODED)


def _deal(batches, cells: Cells, first: np.ndarray, number: np.ndarray):
    for batch in batches:
        cell, size = cells.of(least_hashes(batch.column("hashes"))), np.asarray(batch.column("bytes"))
        ids = batch.column("doc_id")
        dealt = mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) + size.astype(U64) * U64(0x9E3779B97F4A7C15)) % number[cell].astype(U64)
        yield table({"shard": first[cell] + dealt.astype(np.int64), "doc_id": ids, "ids": batch.column("ids")}, DEALT)


def widened(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[:1] == NARROW else "<u4", offset=1).astype("<u4")


class Index:
    """An inverted index of a shard: for each term its documents with their BM25 weights. corpus: documents, mean length and documents by term of the whole corpus; without it, of the shard."""

    def __init__(self, docs: list[np.ndarray], corpus: tuple[int, float, np.ndarray] | None = None):
        terms, counts, self.rows = counted(docs)
        size = np.diff(self.rows)
        df = np.bincount(terms)
        used = np.flatnonzero(df)
        number = np.zeros(len(df), np.int64)
        number[used] = np.arange(len(used))
        self.place, df = number[terms], df[used]
        self.first = np.concatenate([[0], np.cumsum(df)])
        length = np.array([len(d) for d in docs], float)
        n, mean = len(docs), length.mean()
        if corpus is not None:
            n, mean, df = corpus[0], corpus[1], corpus[2][used]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        tf = counts.astype(float)
        weights = idf[self.place] * tf * (K1 + 1) / (tf + np.repeat(K1 * (1 - B + B * length / mean), size))
        order = np.argsort(self.place.astype(np.uint16) if len(used) <= 1 << 16 else self.place, kind="stable")  # by counting, where 16 bits suffice
        self.doc, self.weight = np.repeat(np.arange(len(docs)), size)[order], weights[order]
        self.listed = len(docs)

    def keep(self, free: np.ndarray) -> None:
        """Lists free documents only, once a fifth of the listed ones are not."""
        n = int(free.sum())
        if 5 * n > 4 * self.listed:
            return
        some = free[self.doc]
        self.first = np.concatenate([[0], np.cumsum(some)])[self.first]
        self.doc, self.weight, self.listed = self.doc[some], self.weight[some], n

    def scores(self, seed: int) -> np.ndarray:
        """Scores by all terms of the seed; 0 for documents that aren't listed."""
        own = self.place[self.rows[seed] : self.rows[seed + 1]]
        size = self.first[own + 1] - self.first[own]
        at = np.repeat(self.first[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], minlength=len(self.rows) - 1)


def windows_of(docs: list[np.ndarray], window: int = WINDOW, corpus: tuple[int, float, np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length), each full but for the last."""
    index, n = Index(docs, corpus), len(docs)
    free = np.ones(n, bool)
    at, out, carry = 0, [], None
    while True:
        if carry is None:
            while at < n and not free[at]:
                at += 1
            if at == n:
                return out
            carry = (at, 0)
            free[at] = False
        seed, start = carry
        take = min(window, len(docs[seed]) - start)
        pieces, room = [(seed, start, take)], window - take
        carry = (seed, start + take) if start + take < len(docs[seed]) else None
        if room and free.any():
            index.keep(free)
            score = np.where(free, index.scores(seed), -1.0)
            # Equal scores go by the order of documents; those without a common term come last.
            for other in _ranked(score):
                take = min(room, len(docs[other]))
                free[other] = False
                pieces.append((other, 0, take))
                room -= take
                if take < len(docs[other]):
                    carry = (other, take)
                if not room:
                    break
        out.append(pieces)


def _ranked(score: np.ndarray, some: int = 32):
    """Free documents from the highest score on, a few at first and all if those don't fill the window."""
    given = 0
    if len(score) > some:
        least = -np.partition(-score, some - 1)[some - 1]
        top = np.flatnonzero(score > max(least, -1.0))
        order = top[np.argsort(-score[top], kind="stable")]
        yield from order.tolist()
        given = len(order)
    yield from [i for i in np.argsort(-score, kind="stable")[given:].tolist() if score[i] >= 0]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(shard: pa.Table, window: int, corpus: tuple[int, float, np.ndarray]) -> pa.Table:
    rows = sorted(zip(shard.column("doc_id").to_pylist(), shard.column("ids").to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    docs = [widened(x) for _, x in rows]
    base = shard.column("shard")[0].as_py() << 32
    out = []
    for k, pieces in enumerate(windows_of(docs, window, corpus)):
        offset = 0
        for doc, start, length in pieces:
            out.append((rows[doc][0], start, length, zlib.crc32(docs[doc][start : start + length].tobytes()), len(docs[doc]), base + k, offset))
            offset += length
    made = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)
    del rows, docs, out
    tidy()
    return made


def tokenizer_json(path: str | None = None) -> str:
    """The definition of the tokenizer in a file on the driver; executors get it as a broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def packed(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone. Rows that share a doc_id, and rows without one, are packed each by
    itself, with their ids as they are. An empty table gives no rows. Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    definition = sc.broadcast(tokenizer_json(tokenizer_path))
    encoded = stored(docs.select("doc_id", "text").mapInArrow(lambda it: _encode(it, definition.value), "doc_id long, bytes long, hashes array<long>, ids binary"))
    with small_batches(docs.sparkSession):
        corpus = sc.broadcast(corpus_terms(encoded))
        cells = cells_of(encoded, shard_bytes)
    leaves = cells.leaves()
    first, number = np.zeros(len(cells.base), np.int64), np.ones(len(cells.base), np.int64)
    first[leaves], number[leaves] = shards(cells.sizes[leaves], shard_bytes)
    plan = sc.broadcast((cells, first, number))
    dealt = encoded.mapInArrow(lambda it: _deal(it, *plan.value), "shard long, doc_id long, ids binary")
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack(t, window, corpus.value), PIECES_DDL)
