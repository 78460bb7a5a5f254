"""The trie model against one in plain Python, its sequences against lists, and its base score against SQL."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import edge_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import queries, trie_lm
from quillon.llm.arrow_text import hash_spans
from quillon.llm.elias_fano import DISCOUNT, STEP, Monotone, Trie, code, distinct, prefixes, value

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 2), max_size=200), st.lists(st.integers(0, 2**64 - 2), max_size=50), st.sampled_from([2**64 - 1, 1000, 3]))
def test_sequences_hold_and_find(values, asked, top):
    v = np.sort(np.array([x % top for x in values], np.uint64))
    m = Monotone(Monotone.build(v, top))
    assert m.at(np.arange(len(v))).tolist() == v.tolist()
    q = np.array(sorted({*v.tolist(), *(x % top for x in asked), 2**64 - 2}), np.uint64)
    have = v.tolist()
    assert m.find(q).tolist() == [have.index(x) if x in have else -1 for x in q.tolist()]


def test_sequences_are_compact():
    v = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 1 << 17, dtype=np.uint64))
    assert len(Monotone.build(v, 1 << 40)) * 8 < (40 - 17 + 3) * len(v)


def test_distinct_rows_of_wide_columns():
    r = np.random.default_rng(3)
    columns = [r.integers(0, 5, 300) for _ in range(3)]
    for top in (5, 1 << 40):  # the second doesn't fit in one number
        rows, inverse = distinct(columns, top)
        want = sorted({*zip(*[c.tolist() for c in columns])})
        assert list(zip(*[c.tolist() for c in rows])) == want
        assert [want[i] for i in inverse] == list(zip(*[c.tolist() for c in columns]))


class Plain:
    """Interpolated absolute discounting with quantised parts."""

    def __init__(self, texts, order):
        self.order, self.grams, self.after = order, Counter(), defaultdict(set)
        for tokens in texts:
            s = ["<s>", *tokens, *["<pad>"] * (order - 1)]
            for i in range(len(tokens) + 1):
                for k in range(1, order + 1):
                    g = tuple(s[i : i + k])
                    self.grams[g] += 1
                    if k > 1:
                        self.after[g[:-1]].add(g[-1])
        single = {g[0]: c for g, c in self.grams.items() if len(g) == 1 and g[0] != "<s>"}
        self.counts, self.total, self.distinct = single, sum(single.values()), len(single)

    @staticmethod
    def rounded(p):
        return 10 ** (-round(-math.log10(p) / STEP) * STEP)

    def probability(self, context, word):
        if not context:
            return (self.counts.get(word, 0) + 1) / (self.total + self.distinct + 1)
        lower = self.probability(context[1:], word)
        if context not in self.after:
            return lower
        n = self.grams[context]
        seen = self.rounded((self.grams[(*context, word)] - DISCOUNT) / n) if (*context, word) in self.grams else 0
        return seen + self.rounded(DISCOUNT * len(self.after[context]) / n) * lower

    def score(self, tokens):
        s = ["<s>", *tokens]
        return sum(math.log10(self.probability(tuple(s[max(0, i - self.order + 1) : i]), s[i])) for i in range(1, len(s)))

    def base(self, tokens):
        return sum(math.log10(self.probability((), t)) for t in tokens)


def tokens_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + ["</s>"]


def held(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7 == 2


def check(spark, rows, got, order):
    model = Plain([tokens_of(t) for i, t in rows if held(i) is False], order)
    want = []
    for i, t in rows:
        k = tokens_of(t)
        want.append((i, held(i), len(k), sum(model.counts.get(w, 0) > 0 for w in k), model.total, model.base(k), model.score(k)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6 * w[2]) and g[6] == pytest.approx(w[6], abs=1e-6 * w[2]), g


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_a_plain_model(spark, docs, order):
    check(spark, [(r[0], r[1]) for r in edge_rows()], trie_lm.scored(docs, order=order), order)


def test_hot_words_and_pairs_in_many_shards(spark):
    """One word begins a third of all windows, and one pair most of these: dealt by three words, with counts and weights from all shards."""
    rows = [(i, prose(i, 60) + " " + " ".join(f"of the x{i}_{k} of the river" if k % 2 else f"of a{k} the" for k in range(40))) for i in range(40)] + [(None, "of the"), (7, "of the river")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks = trie_lm.blocks_of(df, trie_lm.default_split(), 3000)
    size = blocks.agg(F.sum("size")).first()[0]
    hot = trie_lm._hot(blocks, 3, size, math.ceil(size / 500))
    assert len(hot) == 2 and hot[0] and hot[1]
    check(spark, rows, trie_lm.scored(df, per_shard=500, block=3000), 3)


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b d a c b a b c d d a " * 3) for i in range(30)]
    model = Plain([tokens_of(t) for i, t in rows if held(i) is False], 3)
    words = ["a", "b", "c", "d", "</s>", "unknown"]
    for context in (("a", "b"), ("<s>", "a"), ("d", "zzz"), ("zzz",), ("c",)):
        assert sum(model.probability(context, w) for w in words) == pytest.approx(1, abs=2e-3)


def test_images_are_tries_that_files_map(spark, docs, tmp_path):
    rows = trie_lm.tries(docs, per_shard=2000).collect()
    assert len(rows) > 1
    model = Plain([tokens_of(r[1]) for r in edge_rows() if held(r[0]) is False], 3)
    found = Counter()
    for r in rows:
        path = tmp_path / str(r.shard)
        path.write_bytes(r.image)
        trie = Trie.open(str(path))
        assert trie.words.n == r.words
        raw = np.frombuffer(b"stonethe", np.uint8)
        word = trie.words.find(hash_spans(raw, np.array([0, 5]), np.array([5, 8])))
        for name, node in zip(("stone", "the"), trie.child(0, np.zeros(2, np.int64), word)):
            if node >= 0:
                found[name] += 1
                children = int(trie.children(0, np.array([node]))[0])
                assert 0 < children <= len(model.after[(name,)])
    assert found["stone"] and found["the"]


def test_no_texts_and_no_training_texts(spark, none, docs):
    assert trie_lm.scored(none).count() == 0
    got = trie_lm.scored(docs, held_out=F.lit(True)).collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in got} == {(0.0, 0.0, 0, 0)}


def test_codes():
    p = np.array([0, 1, 0.75, 1e-9, 1e-40])
    assert code(p).tolist()[:2] == [0, 1] and value(code(p))[:4] == pytest.approx(p[:4], rel=STEP * 2) and value(code(p))[4] > 0
    assert prefixes([np.array([0, 0, 1]), np.array([1, 2, 2])])[1].tolist() == [0, 1, 2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_base_score_equals_sql_and_held_out_texts_gain(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')")
    con.create_function("held", lambda i: zlib.crc32(str(i).encode()) % 7 == 2, ["BIGINT"], "BOOLEAN")
    want = con.execute(r"""
        WITH d AS (SELECT doc_id, held(doc_id) AS h, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' end') AS t FROM documents),
        w AS (SELECT doc_id, h, unnest(t) AS w FROM d),
        c AS (SELECT w, count(*) AS c FROM w WHERE NOT h GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, h, count(*), count(c.c), any_value(n.n), sum(log10((coalesce(c.c, 0) + 1) / (n.n + 1 * (n.v + 1)))) FROM w LEFT JOIN c USING (w), n GROUP BY doc_id, h""").fetchall()
    rows = queries.QUERIES["op12_trie_lm"](spark, SF).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(want)
    for i, h, n, known, total, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total) and r.base_score == pytest.approx(base, abs=1e-6 * n)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
