"""Long lists of spans are compared whole: links that join what all pairs join, and no pairs."""

import random

import brute
import numpy as np
import pytest

from quillon.llm import line_dedup, linking


def joined(n, pairs):
    comp = list(range(n))
    for a, b in pairs:
        comp = [comp[a] if c == comp[b] else c for c in comp]
    return {frozenset(i for i in range(n) if comp[i] == c) for c in comp}


@pytest.mark.parametrize("seed", range(6))
def test_a_forest_joins_what_all_pairs_join(seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**62, 40)
    sets = [np.unique(np.concatenate([common[rng.random(40) < 0.93], rng.integers(0, 2**62, rng.integers(0, 4))])) for _ in range(60)]
    sets += [np.empty(0, np.int64)]
    before = rng.integers(0, 50, len(sets))  # some are joined already
    rows = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    nodes = np.arange(len(sets)) + 1000
    got = linking.forest(nodes, before, np.diff(rows), rows, np.concatenate(sets), 80)
    similar = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x) and 180 * len(np.intersect1d(x, y)) >= 80 * (len(x) + len(y))]
    given = [(i, j) for i in range(len(sets)) for j in range(i) if before[i] == before[j]]
    assert joined(len(sets), [(a - 1000, b - 1000) for a, b in got] + given) == joined(len(sets), similar + given)
    assert len(got) < len(set(before.tolist()))
    assert all((max(a, b) - 1000, min(a, b) - 1000) in set(similar) for a, b in got)


def test_an_empty_list_has_no_forest():
    assert linking.forest(*[np.empty(0, np.int64)] * 3, np.zeros(1, np.int64), np.empty(0, np.int64), 80) == []


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_lines_that_are_nearly_alike_make_no_pairs(spark, monkeypatch, held):
    """As many lines as make long lists, most of them a little less alike than asked for; held: with lists that are too heavy, which make pairs."""
    monkeypatch.setattr(linking, "CAP", 3)
    monkeypatch.setattr(linking, "HELD", held)
    made = []
    pairs = linking._pairs
    monkeypatch.setattr(linking, "_pairs", lambda *a, **k: made.append(1) or pairs(*a, **k))
    r = random.Random(3)
    base = "the quiet river runs by amber fields and under the old copper bridge to the harbour of the north"
    texts = []
    for i in range(80):
        line = list(base)
        for _ in range(r.randrange(1, 5)):
            line[r.randrange(len(line))] = r.choice("qxzjk")
        texts.append((i, "".join(line)))
    got = {r.doc_id: (r.n_lines, list(r.removed_lines)) for r in line_dedup.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute.fuzzy_lines(texts, size=5)
    assert bool(made) == (held == 0)
