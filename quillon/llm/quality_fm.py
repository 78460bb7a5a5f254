"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in
time linear in a document's features. It is fitted by numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SPACE, U64, hash_spans, per_row, slices, table, words_of
from .quality_rules import SYMBOLS, duplicate_lines
from .scratch import stored

WORD_BUCKETS = 1 << 15
FACTORS = 8
#: Labelled documents that the machine is fitted on, at most; those with the smallest hashes of their ids.
TRAIN_DOCS = 4000
#: Least score of a document that is predicted to be good.
THRESHOLD = 0.3
#: Passes over the sample, and least number of steps of 64 documents.
EPOCHS = 12
STEPS = 800
STATS = ("log_words", "word_length", "upper_share", "symbol_share", "digit_share", "mark_share", "non_ascii_share", "duplicate_line_share", "log_lines", "distinct_share", "has_words", "log_n_chars", "has_n_chars")

UPPER, DIGIT, LETTER, MARK = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
DIGIT[48:58] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
MARK[33:127] = True
MARK &= ~(LETTER | DIGIT)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (bucket, weight) with each row's first, the weights of a row having length 1; and the statistics, one column for each of STATS."""
    w = words_of(batch.column("text"))
    n = w.counts
    bucket = (hash_spans(w.data, w.starts, w.ends) & U64(WORD_BUCKETS - 1)).astype(np.int64)
    key, count = np.unique(w.row_of * WORD_BUCKETS + bucket, return_counts=True)
    row = key // WORD_BUCKETS
    rows = np.searchsorted(row, np.arange(len(n) + 1))
    weight = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(n)))
    size = np.maximum(per_row(w.solid, w.offsets), 1)
    share = lambda mask: per_row(mask[w.data], w.offsets) / size
    lines = per_row(w.data == 10, w.offsets) + 1
    given = batch.column("n_chars").cast(pa.float64()) if "n_chars" in batch.schema.names else pa.nulls(len(n), pa.float64())
    known = np.asarray(given.is_valid())
    n_chars = np.maximum(given.fill_null(0).to_numpy(zero_copy_only=False), 0)
    stats = np.stack([np.log1p(n), size / np.maximum(n, 1), share(UPPER), share(SYMBOLS), share(DIGIT), share(MARK), share(~SPACE & (np.arange(256) > 127)), duplicate_lines(w.data, w.offsets) / lines, np.log1p(lines), np.diff(rows) / np.maximum(n, 1), n > 0, np.where(known, np.log1p(n_chars), 0), known], 1)
    return key % WORD_BUCKETS, (weight / norm[row]), rows, stats


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  #: of hashed words, then of statistics
    factors: np.ndarray  #: a row for each of them
    mean: np.ndarray  #: of the statistics in the sample
    scale: np.ndarray

    def standardised(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -5, 5)

    def score(self, bucket: np.ndarray, weight: np.ndarray, rows: np.ndarray, stats: np.ndarray) -> np.ndarray:
        z = self.standardised(stats)
        own, v = self.weights[WORD_BUCKETS:], self.factors[WORD_BUCKETS:]
        row = np.repeat(np.arange(len(z)), np.diff(rows))
        linear = self.bias + z @ own + np.bincount(row, self.weights[bucket] * weight, minlength=len(z))
        pairs = np.zeros(len(z))
        for f in range(self.factors.shape[1]):
            x = self.factors[bucket, f] * weight
            total = np.bincount(row, x, minlength=len(z)) + z @ v[:, f]
            squares = np.bincount(row, x * x, minlength=len(z)) + (z * z) @ (v[:, f] ** 2)
            pairs += (total * total - squares) / 2
        return 1 / (1 + np.exp(-np.clip(linear + pairs, -30, 30)))


def fit(bucket: np.ndarray, weight: np.ndarray, rows: np.ndarray, stats: np.ndarray, label: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the log loss, in batches of 64; the same sample gives the same machine."""
    rng = np.random.default_rng(seed)
    d, n = WORD_BUCKETS + stats.shape[1], len(label)
    m = Machine(0.0, np.zeros(d), rng.normal(0, 0.02, (d, factors)), stats.mean(0) if n else np.zeros(stats.shape[1]), np.maximum(stats.std(0), 1e-3) if n else np.ones(stats.shape[1]))
    if not n:
        m.factors[:] = 0
        return m
    rate_of = np.clip(label.mean(), 0.01, 0.99)
    m.bias = float(np.log(rate_of / (1 - rate_of)))
    z = m.standardised(stats)
    g_w, g_v, g_b = np.full(d, 1e-2), np.full((d, factors), 1e-2), 1e-2
    for _ in range(max(epochs, STEPS * 64 // n)):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            docs = order[at : at + 64]
            count = np.diff(rows)[docs]
            pick = np.repeat(rows[docs] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            s = stats.shape[1]
            row = np.concatenate([np.repeat(np.arange(len(docs)), count), np.repeat(np.arange(len(docs)), s)])
            code = np.concatenate([bucket[pick], np.tile(np.arange(WORD_BUCKETS, d), len(docs))])
            x = np.concatenate([weight[pick], z[docs].ravel()])
            v = m.factors[code]
            vx = v * x[:, None]
            total = np.stack([np.bincount(row, vx[:, f], minlength=len(docs)) for f in range(factors)], 1)
            out = m.bias + np.bincount(row, m.weights[code] * x, minlength=len(docs)) + (total**2).sum(1) / 2 - np.bincount(row, (vx**2).sum(1), minlength=len(docs)) / 2
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[docs]) / len(docs)
            used, place = np.unique(code, return_inverse=True)
            e = error[row] * x
            grad_w = np.bincount(place, e, minlength=len(used)) + decay * m.weights[used]
            inner = e[:, None] * (total[row] - vx)
            grad_v = np.stack([np.bincount(place, inner[:, f], minlength=len(used)) for f in range(factors)], 1) + decay * m.factors[used]
            g_w[used] += grad_w**2
            g_v[used] += grad_v**2
            g_b += error.sum() ** 2
            m.weights[used] -= rate * grad_w / np.sqrt(g_w[used])
            m.factors[used] -= rate * grad_v / np.sqrt(g_v[used])
            m.bias -= rate * error.sum() / np.sqrt(g_b)
    return m


SAMPLE_DDL = "doc_id long, label double, bucket array<int>, weight array<float>, stats array<double>"
SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("bucket", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32())), ("stats", pa.list_(pa.float64()))])


def _sampled(batches):
    for batch in slices(batches):
        bucket, weight, rows, stats = features(batch)
        lists = lambda values, at, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
        yield table({"doc_id": batch.column("doc_id"), "label": batch.column("label").cast(pa.float64()), "bucket": lists(bucket, rows, pa.int32()), "weight": lists(weight, rows, pa.float32()), "stats": lists(stats.ravel(), np.arange(len(stats) + 1) * stats.shape[1], pa.float64())}, SAMPLE)


def held_out(doc_id, folds: int = 5):
    return F.crc32(doc_id.cast("string")) % folds == 0


def trained(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Machine:
    """A machine fitted on at most ``train_docs`` labelled documents that are not held out. Rows with a null id or label, or a label other than 0 and 1, teach nothing; of several labels of one id the least counts, of several rows the first by text and n_chars."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    columns = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    read = docs.select(*columns).join(F.broadcast(sample), "doc_id")
    one = read.groupBy("doc_id").agg(F.min(F.struct(*columns[1:], "label")).alias("row")).select("doc_id", "row.*")
    got = one.mapInArrow(_sampled, SAMPLE_DDL).toPandas().sort_values("doc_id")
    size = [len(x) for x in got["bucket"]]
    flat = lambda column, kind: np.concatenate([np.empty(0, kind), *got[column]]).astype(kind)
    return fit(flat("bucket", np.int64), flat("weight", np.float64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), flat("stats", np.float64).reshape(-1, len(STATS)), got["label"].to_numpy(np.float64))


def _sent(docs: DataFrame, labels: DataFrame, train_docs: int):
    """A broadcast of the machine's plain arrays; workers need no class of this package to read it."""
    m = trained(docs, labels, train_docs)
    return docs.sparkSession.sparkContext.broadcast((m.bias, m.weights, m.factors, m.mean, m.scale))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text, n_chars if there): doc_id, held_out, score, predicted.

    Null and empty texts have no words and are scored by their statistics; a null or missing n_chars is a feature of its
    own; held_out is false for a null doc_id. Without a label every score is 1/2. Other columns are not read.
    """
    machine = _sent(docs, labels, train_docs)
    columns = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]

    def run(batches):
        for batch in slices(batches):
            yield table({"doc_id": batch.column("doc_id"), "score": Machine(*machine.value).score(*features(batch))}, SCORED)

    out = docs.select(*columns).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; see scored."""
    machine = _sent(docs, labels, train_docs)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(Machine(*machine.value).score(*features(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
