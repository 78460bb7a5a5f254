"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into windows of SPAN bytes, all of them; in each window one network reads forwards and one backwards, every
position gets a probability for each language, and a document's probabilities are the mean over all its positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, table, utf8_bytes
from .scratch import stored

SPAN = 64
HIDDEN = 8
#: Documents that the network is trained on, at most (those with the smallest hashes of their ids), with their whole texts.
TRAIN_DOCS = 400
#: Passes over the windows, and least number of steps of BATCH windows.
EPOCHS = 2
STEPS = 300
BATCH = 128
#: Windows that are scored at once; their state stays in a core's cache.
BLOCK = 2048
UNKNOWN = "und"


@dataclass
class Direction:
    inputs: np.ndarray  #: 3H x 256: what each byte adds to the update gate, the reset gate and the candidate
    update: np.ndarray  #: 2H x H, from the state to the gates
    candidate: np.ndarray  #: H x H, from the state to the candidate

    def states(self, steps: np.ndarray, keep: bool = False):
        """States after each step (steps x H x windows). steps: bytes, one row for each step."""
        h_size, half = len(self.candidate), np.float32(0.5)
        h = np.zeros((h_size, steps.shape[1]), np.float32)
        out = np.empty((len(steps), *h.shape), np.float32)
        kept = []
        for t, codes in enumerate(steps):
            x = np.take(self.inputs, codes, 1)
            gates = self.update @ h
            gates += x[: 2 * h_size]
            gates *= half
            np.tanh(gates, gates)
            gates *= half
            gates += half
            z, r = gates[:h_size], gates[h_size:]
            u = self.candidate @ h
            c = r * u
            c += x[2 * h_size :]
            np.tanh(c, c)
            if keep:
                kept.append((h, z, r, u, c))
            h = h - c
            h *= z
            h += c
            out[t] = h
        return (out, kept) if keep else out

    def backward(self, steps: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of inputs, update and candidate from those of all states, back through time."""
        h_size = len(self.candidate)
        grads = [np.zeros_like(self.inputs), np.zeros_like(self.update), np.zeros_like(self.candidate)]
        later = np.zeros_like(d_out[0])
        into = np.empty((len(steps), 3 * h_size, steps.shape[1]), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, u, c = kept[t]
            d = d_out[t] + later
            d_c = d * (1 - z) * (1 - c * c)
            d_u = d_c * r
            d_gates = np.concatenate([d * (h - c) * z * (1 - z), d_c * u * r * (1 - r)])
            later = d * z + self.update.T @ d_gates + self.candidate.T @ d_u
            grads[1] += d_gates @ h.T
            grads[2] += d_u @ h.T
            into[t, : 2 * h_size], into[t, 2 * h_size :] = d_gates, d_c
        flat = steps.ravel()
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        grads[0][:, used] = np.add.reduceat(into.transpose(1, 0, 2).reshape(3 * h_size, -1)[:, order], first, axis=1)
        return grads


@dataclass
class Network:
    languages: list[str]
    forwards: Direction
    backwards: Direction
    output: np.ndarray  #: languages x 2H
    bias: np.ndarray  #: languages x 1

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each position: SPAN x languages x windows."""
        steps = np.ascontiguousarray(windows.T)
        h = len(self.forwards.candidate)
        p = self.output[:, :h] @ self.forwards.states(steps)
        p += self.output[:, h:] @ self.backwards.states(steps[::-1])[::-1]
        p += self.bias
        p -= p.max(1, keepdims=True)
        np.exp(p, p)
        p /= p.sum(1, keepdims=True)
        return p

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for one without a byte."""
        data, offsets = utf8_bytes(texts)
        windows, count = cut(data, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), -(-np.diff(offsets) // SPAN))
        sums = np.zeros((len(windows), len(self.languages)))
        for at in range(0, len(windows), BLOCK):
            p = self.positions(windows[at : at + BLOCK])
            p *= (np.arange(SPAN)[:, None] < count[at : at + BLOCK])[:, None, :]
            sums[at : at + BLOCK] = p.sum(0).T
        total = np.stack([np.bincount(doc, sums[:, k], minlength=len(offsets) - 1) for k in range(sums.shape[1])], 1)
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows, the last of a row filled up with spaces, and their numbers of own bytes."""
    size = np.diff(offsets)
    n = -(-size // SPAN)
    place = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    start = np.repeat(offsets[:-1], n) + place * SPAN
    count = np.minimum(SPAN, np.repeat(offsets[1:], n) - start)
    padded = np.concatenate([data, np.full(SPAN, 32, np.uint8)])
    windows = padded[start[:, None] + np.arange(SPAN)]
    windows[np.arange(SPAN) >= count[:, None]] = 32
    return windows, count


def fit(windows: np.ndarray, count: np.ndarray, label: np.ndarray, languages: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the cross entropy of every position, each language with the same total weight."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(hidden)).astype(np.float32)
    net = Network(languages, *(Direction(draw(3 * hidden, 256), draw(2 * hidden, hidden), draw(hidden, hidden)) for _ in range(2)), draw(k, 2 * hidden), np.zeros((k, 1), np.float32))
    params = [net.forwards.inputs, net.forwards.update, net.forwards.candidate, net.backwards.inputs, net.backwards.update, net.backwards.candidate, net.output, net.bias]
    first, second, n = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(label) / (k * np.maximum(np.bincount(label, minlength=k), 1))).astype(np.float32)[label]
    epochs = max(epochs, STEPS * BATCH // max(len(label), 1))
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            steps = np.ascontiguousarray(windows[pick].T)
            f, f_kept = net.forwards.states(steps, True)
            b, b_kept = net.backwards.states(steps[::-1], True)
            both = np.concatenate([f, b[::-1]], 1)
            logits = net.output @ both + net.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[:, label[pick], np.arange(len(pick))] -= 1
            live = (np.arange(SPAN)[:, None] < count[pick]) * weight[pick]
            d = (p * (live / max(live.sum(), 1))[:, None, :]).astype(np.float32)
            into = net.output.T @ d
            grads = [*net.forwards.backward(steps, f_kept, into[:, :hidden]), *net.backwards.backward(steps[::-1], b_kept, into[::-1, hidden:]), np.einsum("tkn,thn->kh", d, both, optimize=True), d.sum((0, 2))[:, None]]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            n += 1
            step = rate * (0.3 if epoch == epochs - 1 else 1)
            for p_, g, m, v in zip(params, grads, first, second):
                g = g * np.float32(min(1, 1 / (norm + 1e-9)))
                m += (g - m) * np.float32(0.1)
                v += (g * g - v) * np.float32(0.001)
                p_ -= np.float32(step) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + np.float32(1e-8))
    return net


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def trained(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network trained on at most ``train_docs`` documents with a language that are not held out; None without any. Of several rows of one id the first by language and text teaches."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sample = stored(usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.*")
    got = sorted((r for r in rows.collect() if r["text"]), key=lambda r: r["doc_id"])
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    data, offsets = utf8_bytes(pa.array([r["text"] for r in got], pa.string()))
    windows, count = cut(data, offsets)
    label = np.repeat([languages.index(r["lang"]) for r in got], -(-np.diff(offsets) // SPAN))
    return fit(windows, count, label, languages)


def plain(net: Network) -> tuple:
    """The network as a tuple of arrays; workers need no class of this package to read it."""
    arrays = lambda d: (d.inputs, d.update, d.candidate)
    return net.languages, arrays(net.forwards), arrays(net.backwards), net.output, net.bias


def rebuilt(x: tuple) -> Network:
    return Network(x[0], Direction(*x[1]), Direction(*x[2]), x[3], x[4])


SCORED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    lang is read for training only. A null text and one without a letter get ``und`` and score 0, as does every text if
    nothing can be learned; held_out is false for a null doc_id. Repeated rows get a row each. Other columns are not read.
    """
    net = trained(docs, train_docs)
    network = docs.sparkSession.sparkContext.broadcast(net and plain(net))

    def run(batches):
        net = network.value and rebuilt(network.value)
        for batch in slices(batches):
            letters = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool)
            if net is None:
                found, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = net.documents(batch.column("text"))
                found = np.where(letters, np.array(net.languages, object)[p.argmax(1)], UNKNOWN).tolist()
                score = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
            yield table({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(found, pa.string()), "score": score}, SCORED)

    read = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = read.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
