"""Families of spans: joined by signatures without pairs, and compared whole."""

import brute
import numpy as np
import pytest

from quillon.llm import families, line_dedup
from quillon.llm.scratch import Scratch


def alike(sets, percent=80):
    return [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x) and (100 + percent) * len(np.intersect1d(x, y)) >= percent * (len(x) + len(y))]


def parts(labels):
    labels = np.asarray(labels)
    return {frozenset(np.flatnonzero(labels == x).tolist()) for x in labels.tolist()}


def joined(n, pairs):
    comp = list(range(n))
    for a, b in pairs:
        comp = [comp[a] if c == comp[b] else c for c in comp]
    return parts(comp)


@pytest.mark.parametrize("n", [5, 60, 400])
def test_a_family_is_compared_whole(n):
    """Nodes about as alike as asked for, by common tokens and by ones that few have."""
    rng = np.random.default_rng(n)
    common, rare = rng.integers(0, 2**48, 40).astype(np.uint64), rng.integers(0, 2**48, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[rng.random(40) < 0.9], rng.choice(rare, rng.integers(0, 9))])) for _ in range(n)]
    rows = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    assert parts(families.classes(rows, np.concatenate(sets), 80)) == joined(n, alike(sets))


def test_small_families_are_compared_together():
    rng = np.random.default_rng(2)
    start, sets = [0], []
    for _ in range(50):
        common = rng.integers(0, 2**48, 30).astype(np.uint64)
        sets += [np.unique(np.concatenate([common[rng.random(30) < 0.92], rng.integers(0, 2**48, 1).astype(np.uint64)])) for _ in range(rng.integers(1, families.FEW + 1))]
        start.append(len(sets))
    rows = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    assert parts(families.few_classes(np.array(start), rows, np.concatenate(sets), 80)) == joined(len(sets), alike(sets))


def test_a_chain_is_one_family_after_few_rounds(spark, monkeypatch):
    """A chain in an order that hides its least node, and a pair; a signature of n nodes gives n - 1 edges."""
    n = 300
    order = np.random.default_rng(4).permutation(n)
    chain = [(int(min(x)), int(max(x))) for x in zip(order, order[1:])] + [(1000, 1001)]
    scratch, rounds, settled = Scratch(spark), [], Scratch.settled
    monkeypatch.setattr(Scratch, "settled", lambda self, df: rounds.append(1) or settled(self, df))
    got = {r.node: r.family for r in families.families(scratch.stored(spark.createDataFrame(chain, "a long, b long")), scratch).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000} and len(rounds) <= 10
    signed = spark.createDataFrame([(i, [7, 100 + i]) for i in range(50)], "node long, sigs array<long>")
    made = families.edges(signed, 100).collect()
    assert len(made) == 49 and len({r.b for r in made}) == 49
    scratch.clear()


def test_rows_of_one_doc_id_and_wide_characters(spark):
    base = "über die brücke 東京 läuft der fluß und weiter durch das tal zum meer 🌊 und zurück"
    docs = [(1, base), (1, base), (2, base.replace("tal", "tol")), (3, base.replace("meer", "mehr")), (4, "ganz anders"), (5, "ab")]
    got = {r.doc_id: (r.n_lines, list(r.removed_lines)) for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.fuzzy_lines(docs[1:], size=5) and got[2] == got[3] == (1, [0])
