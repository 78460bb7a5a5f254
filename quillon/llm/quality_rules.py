"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed word unigrams and bigrams are counted: of a trusted target and of the whole raw corpus. A
document's score is the mean, over its n-grams, of log(p_target / p_raw); it is kept if the score reaches the threshold.
Nothing is drawn at random: equal texts get equal verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, Words, hash_spans, mix, per_row, slices, table, words_of
from .scratch import small, stored

BUCKETS = 1 << 16
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.05
#: Least mean log ratio that is kept.
THRESHOLD = -0.3
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ngrams(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each row's unigrams and bigrams, and each row's first."""
    h = hash_spans(w.data, w.starts, w.ends)
    n = w.counts
    out = np.concatenate([[0], np.cumsum(np.maximum(2 * n - 1, 0))])
    at = out[:-1].repeat(n) + np.arange(len(h)) - w.rows[:-1].repeat(n)
    code = np.empty(out[-1], np.int64)
    code[at] = (h & U64(buckets - 1)).astype(np.int64)
    has_next = np.ones(len(h), bool)
    has_next[w.rows[1:][n > 0] - 1] = False
    first = np.flatnonzero(has_next)
    code[at[first] + n.repeat(n)[first]] = (mix(h[first] ^ mix(h[first + 1] + U64(1))) & U64(buckets - 1)).astype(np.int64)
    return code, out


COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])


def _count(batches, buckets: int):
    target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in slices(batches):
        code, out = ngrams(words_of(batch.column("text")), buckets)
        raw += np.bincount(code, minlength=buckets)
        trusted = np.asarray(batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False), bool)
        target += np.bincount(code[trusted.repeat(np.diff(out))], minlength=buckets)
    seen = np.flatnonzero(raw)
    yield table({"bucket": seen.astype(np.int32), "target": target[seen], "raw": raw[seen]}, COUNTS)


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, counted over every document; ``buckets`` numbers come to the driver, whatever the input's size."""
    ids = stored(trusted_ids.select("doc_id").where("doc_id is not null").distinct()).withColumn("trusted", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if small(ids) else ids, "doc_id", "left").select("text", "trusted")
    counted = marked.mapInArrow(lambda it: _count(it, buckets), "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    got = counted.toPandas()
    target, raw = np.zeros(buckets), np.zeros(buckets)
    target[got["bucket"]], raw[got["bucket"]] = got["target"], got["raw"]
    p = lambda x: np.log((x + max(x.sum() / buckets, 1e-9) * smoothing) / (max(x.sum(), 1e-9 * buckets) * (1 + smoothing)))
    return np.zeros(buckets, np.float32) if not target.sum() else (p(target) - p(raw)).astype(np.float32)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row: lines with a word that equal an earlier line."""
    out = np.zeros(len(offsets) - 1, np.int64)
    breaks = per_row(data == 10, offsets)
    raw = data.tobytes()
    for i in np.flatnonzero(breaks):
        seen: set[bytes] = set()
        n = 0
        for line in raw[offsets[i] : offsets[i + 1]].split(b"\n"):
            if line in seen:
                n += bool(line) and not line.isspace()
            else:
                seen.add(line)
        out[i] = n
    return out


def repeated_words(hashes: np.ndarray, rows: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Of each row: words inside a window of ``width`` words that the row has twice or more. Windows are compared by 64-bit hashes within a row."""
    out = np.zeros(len(rows) - 1, np.int64)
    if len(hashes) < width:
        return out
    n = len(hashes) - width + 1
    h = mix(hashes[:n])
    for k in range(1, width):
        h = mix(h ^ hashes[k : k + n])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inside = row[:n] == row[width - 1 :]
    key = mix(h + mix(row[:n].astype(U64)))[inside]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return out
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    begin = np.zeros(len(hashes), bool)
    begin[np.flatnonzero(inside)[twice[place] == key]] = True
    covered = begin.copy()
    for k in range(1, width):
        covered[k:] |= begin[:-k]
    return per_row(covered, rows)


FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("log_ratio", pa.float64()), ("kept", pa.bool_())])
FOUND_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean"


def _judge(batches, ratios: np.ndarray, threshold: float):
    for batch in slices(batches):
        w = words_of(batch.column("text"))
        n = w.counts
        repeated = repeated_words(hash_spans(w.data, w.starts, w.ends), w.rows)
        failed = (n < 10) | (100 * repeated > 20 * n)
        code, out = ngrams(w, len(ratios))
        size = np.diff(out)
        score = np.zeros(len(n))
        score[size > 0] = np.add.reduceat(ratios[code].astype(np.float64), out[:-1][size > 0]) / size[size > 0] if len(code) else 0
        yield table({"doc_id": batch.column("doc_id"), "n_words": n, "word_chars": per_row(w.solid & ((w.data & 0xC0) != 0x80), w.offsets), "n_symbols": per_row(SYMBOLS[w.data], w.offsets), "n_dup_lines": duplicate_lines(w.data, w.offsets), "n_repeat_words": repeated, "base_failed": failed, "log_ratio": score, "kept": ~failed & (score >= threshold)}, FOUND)


def judged(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """One row for each row of docs (doc_id, text): the base rules' counts, base_failed, log_ratio, kept.

    ``trusted_ids`` (doc_id) names the target's documents; null, unknown and repeated ids there count once or not at all,
    and with no target document in docs every ratio is 0, so that the base rules alone decide. Null and empty texts have
    no words and fail the base rules. Equal texts and repeated ids get a row each. Other columns are not read.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted_ids, buckets, smoothing))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _judge(it, ratios.value, threshold), FOUND_DDL)
