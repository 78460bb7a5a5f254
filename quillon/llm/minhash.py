"""MinHash signatures and bands of contiguous runs of 64-bit shingle hashes."""

from __future__ import annotations

from functools import cache

import numpy as np

from .arrow_text import U64, mix

#: Of a bin without a hash; a hash that ends so is left out.
NONE = np.uint32(0xFFFFFFFF)


def bands(hashes: np.ndarray, rows: np.ndarray, n_bands: int, band_rows: int) -> np.ndarray:
    """A 64-bit key of each band of each row (rows x n_bands). rows: first hash of each row, one more than rows; no row is empty.

    One permutation: each hash falls in one of n_bands * band_rows bins, each bin keeps its least, and an empty bin
    borrows from the first that isn't in an order of its own, so that bins of a band borrow from different ones. So all
    hashes are computed once.
    """
    n, bins = len(rows) - 1, n_bands * band_rows
    lenders = _lenders(bins)
    factors = mix(np.arange(band_rows, dtype=np.uint64) + U64(77)) | U64(1)
    out = np.empty((n, n_bands), U64)
    # As many rows at once as keep the place of row and bin in 32 bits and the work in a core's cache.
    cuts = np.unique(np.concatenate([[0, n], np.searchsorted(rows, np.arange(1 << 16, rows[-1], 1 << 16))])) if n else [0]
    for a, b in zip(cuts, cuts[1:]):
        x = mix(hashes[rows[a] : rows[b]])
        place = np.repeat(np.arange(b - a) * bins, np.diff(rows[a : b + 1]))
        place += ((x >> U64(32)) * U64(bins) >> U64(32)).view(np.int64)
        least = np.full((b - a) * bins, NONE, np.uint32)
        np.minimum.at(least, place, x.astype(np.uint32))
        value = least.copy()
        empty = np.flatnonzero(value == NONE)
        bin_ = empty % bins
        for turn in range(bins):
            if not len(empty):
                break
            lent = least[empty - bin_ + lenders[turn][bin_]]
            value[empty] = lent
            still = lent == NONE
            empty, bin_ = empty[still], bin_[still]
        value = value.reshape(b - a, n_bands, band_rows)
        h = np.zeros((b - a, n_bands), U64) + np.arange(1, n_bands + 1, dtype=np.uint64) * U64(0x100000001B3)
        for k in range(band_rows):
            h += value[:, :, k] * factors[k]
        out[a:b] = mix(h)
    return out


@cache
def _lenders(bins: int) -> np.ndarray:
    """By turns, the bin from which each bin borrows."""
    return np.ascontiguousarray(np.argsort(mix(np.arange(bins * bins, dtype=np.uint64)).reshape(bins, bins), 1).T)


def recall(similarity: float, n_bands: int, band_rows: int) -> float:
    """Share of pairs of that similarity that meet in a band."""
    return 1 - (1 - similarity**band_rows) ** n_bands


def tuned(similarity: float, least_recall: float, most_hashes: int = 64) -> tuple[int, int]:
    """Bands and rows with that recall: of those with at most so many hashes the most rows (fewest false pairs), then the fewest bands."""
    for band_rows in range(8, 0, -1):
        for n_bands in range(1, most_hashes // band_rows + 1):
            if recall(similarity, n_bands, band_rows) >= least_recall:
                return n_bands, band_rows
    return most_hashes, 1
