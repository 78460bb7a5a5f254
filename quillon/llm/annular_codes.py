"""Vector codes by product quantisation; nearest entries are found by annular norm pruning.

A codebook's entries are sorted by norm. An entry e is at least | |e| - |q| | from a query q, so once some entry is known at
distance d, only entries with norms in [|q| - d, |q| + d] can be as near. A query looks at a few entries of the nearest norms
for its first d, finds that annulus by binary search, ends included, and computes the distances in it, exactly, as
integers. Codebooks are trained on every vector; a round sends one sum for each entry and component to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small, stored
from .vectors import integers, matrix, means, total_rows, totals, whole

PARTS, ENTRIES, ROUNDS, DIMS = 4, 256, 4, 64
#: Entries of the nearest norms that give a query its first distance.
PROBES = 8
#: Distances that are computed at once.
PAIRS = 1 << 18


class Annuli:
    """A codebook (entries by components) sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.size = len(entries)
        square = np.square(entries).sum(1)
        self.order = np.argsort(square, kind="stable")
        self.entries, self.norms = entries[self.order], np.sqrt(square[self.order])
        self.computed = 0

    def _distance(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.computed += len(row)
        return np.square(x[row] - self.entries[at]).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (ties: the lower index) and its squared distance."""
        n, probes = len(x), min(PROBES, self.size)
        norm = np.sqrt(np.square(x).sum(1))
        first = np.clip(np.searchsorted(self.norms, norm) - probes // 2, 0, self.size - probes)
        reach = np.full(n, np.iinfo(np.int64).max)
        for k in range(probes):
            reach = np.minimum(reach, self._distance(x, np.arange(n), first + k))
        # Norms are rounded; the annulus is wider by more than that, so no entry on its edge is missed.
        d = np.sqrt(reach)
        slack = 1e-9 * (norm + d) + 1e-9
        low = np.searchsorted(self.norms, norm - d - slack, "left")
        high = np.searchsorted(self.norms, norm + d + slack, "right")
        best, least = np.empty(n, np.int64), np.empty(n, np.int64)
        ends = np.cumsum(high - low)
        cuts = np.unique(np.concatenate([[0, n], np.searchsorted(ends, np.arange(PAIRS, ends[-1] if n else 0, PAIRS))]))
        for a, b in zip(cuts, cuts[1:]):
            wide = (high - low)[a:b]
            begin = np.cumsum(wide) - wide
            row = np.repeat(np.arange(a, b), wide)
            at = np.arange(len(row)) - np.repeat(begin, wide) + np.repeat(low[a:b], wide)
            dist = self._distance(x, row, at)
            least[a:b] = np.minimum.reduceat(dist, begin)
            index = np.where(dist == np.repeat(least[a:b], wide), self.order[at], self.size)
            best[a:b] = np.minimum.reduceat(index, begin)
        return best, least


def _encode(x: np.ndarray, books: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """Rows by parts: indexes, and squared distances."""
    width = x.shape[1] // len(books)
    found = [book.nearest(x[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(batches, codebooks: np.ndarray):
    parts, size, width = codebooks.shape
    books, out = [Annuli(c) for c in codebooks], np.zeros((parts, size, width + 1), np.int64)
    for batch in batches:
        x = matrix(batch, "x", parts * width)
        codes, _ = _encode(x, books)
        for p in range(parts):
            out[p] += totals(x[:, p * width : (p + 1) * width], codes[:, p], size)
    yield total_rows(out)


CODED_DDL = "vec_id long, label int, code string, error long"


def _codes(batches, codebooks: np.ndarray):
    parts, _, width = codebooks.shape
    books = [Annuli(c) for c in codebooks]
    for batch in batches:
        codes, errors = _encode(matrix(batch, "x", parts * width), books)
        text = ["".join(f"{i:02x}" for i in row) for row in codes.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS) -> np.ndarray:
    """Codebooks (parts, entries, components) of stored rows (vec_id, x): they start as the vectors with the least ids (equal ids by components; rows without an id never), then each round takes every entry to the mean of its parts, rounded down."""
    first = vectors.where("vec_id is not null").select("vec_id", "x").orderBy("vec_id", "x").limit(entries).collect()
    codebooks = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    size = len(first)
    for _ in range(rounds if size else 0):
        now = codebooks
        sums = vectors.select("x").mapInArrow(lambda it, c=now: _sums(it, c), "at long, total long")
        codebooks = means(sums, parts * size, dims // parts, codebooks.reshape(parts * size, -1)).reshape(codebooks.shape)
    return codebooks


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """One row for each whole vector of ``vectors`` (vec_id, embedding, label): code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null or a number that isn't finite are left out; components beyond 65,536 in size end
    the job. A vector of another length than ``dims`` belongs to no codebook: it stays, with null code and error. Repeated
    rows and ids are coded row by row; rows without an id are coded, and counted in the means, but start no entry. With fewer
    vectors than entries the codebooks are smaller, and without any that can start an entry codes are null. label_error sums
    the errors of equal labels, null ones together (null where none has an error). Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    kept = vectors.select("vec_id", "embedding", "label").where(whole(F.col("embedding")))
    rows = scratch.stored(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), integers(F.col("embedding")).alias("x")))
    fit = rows.where(F.size("x") == dims)
    codebooks = trained(fit, parts, entries, rounds, dims)
    name = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    bare = F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    if codebooks.size:
        out = fit.mapInArrow(lambda it: _codes(it, codebooks), CODED_DDL).unionByName(rows.where(F.size("x") != dims).select("vec_id", "label", *bare))
    else:
        out = rows.select("vec_id", "label", *bare)
    out = stored(out)
    scratch.clear()
    sums = scratch.stored(out.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(sums) if small(sums) else sums
    return out.join(sums, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
