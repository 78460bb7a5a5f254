"""Clustering and vector codes against all distances in plain Python, and on odd rows."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import annular_codes, queries, sort_means

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, code int, error string, distance int"


def odd_rows(dims):
    r = random.Random(5)
    vec = lambda: [round(r.uniform(-0.5, 0.5), 3) for _ in range(dims)]
    twin = vec()
    rows = [(i, vec(), i % 3) for i in range(60)] + [(100, twin, 1), (101, twin, None), (101, twin, None), (102, [0.25] * dims, None), (102, [-0.25] * dims, 2), (None, vec(), 1), (None, None, None)]
    rows += [(200, None, 1), (201, [], 1), (202, vec()[:-1], 1), (203, [None] * dims, 1), (204, vec()[:-1] + [math.nan], 7), (205, vec()[:-1] + [math.inf], 7), (206, vec() + [0.1], 8)]
    return [(*row, "x", "c", 7, "e", 9) for row in rows]


def whole(row, dims=None):
    v = row[1]
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (dims is None or len(v) == dims)


def ints(v):
    return tuple(math.floor(1024 * float(np.float32(x))) for x in v)


def nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(entries))


def moved(xs, entries):
    own = [nearest(x, entries)[1] for x in xs]
    out = []
    for i, e in enumerate(entries):
        mine = [x for x, o in zip(xs, own) if o == i]
        out.append(tuple(sum(c) // len(mine) for c in zip(*mine)) if mine else e)
    return out


def brute_clusters(rows, k, dims, rounds, seed):
    kept = [(r[0], ints(r[1])) for r in rows if whole(r, dims)]
    centroids = [x for _, x in sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None))[:k]]
    for _ in range(rounds):
        centroids = moved([x for _, x in kept], centroids)
    found = [(i, *nearest(x, centroids)[::-1]) for i, x in kept]
    total = sum(d for _, _, d in found)
    return sorted(((i, c, d, sum(e for _, b, e in found if b == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def test_clusters_equal_all_distances(spark):
    rows = odd_rows(6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, sort_means.assigned(df, k=5, dims=6, rounds=4).collect()), key=str)
    assert got == brute_clusters(rows, 5, 6, 4, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0), (None, [0.1, 0.2], 0)], "vec_id long, embedding array<double>, label int")
    got = sort_means.assigned(df, k=8, dims=2).collect()
    assert {(r.vec_id, r.cluster) for r in got} == {(1, 1), (None, 0)} and len(got) == 3  # of two equal centroids the first takes all, and moves
    for empty in (df.where("false"), df.where("vec_id is null")):
        assert sort_means.assigned(empty, k=8, dims=2).count() == 0


def test_scans_stop_early_and_are_exact():
    r = np.random.default_rng(1)
    centroids = np.concatenate([r.integers(-9, 9, (10, 4)), r.integers(900, 918, (10, 4))])
    x = centroids[r.integers(0, 20, 500)] + r.integers(-3, 4, (500, 4))
    last = np.array([nearest(v, centroids)[1] for v in x.tolist()])
    best, least, computed = sort_means.scan(x, last, centroids, *sort_means.neighbours(centroids))
    assert list(zip(least.tolist(), best.tolist())) == [nearest(v, centroids.tolist()) for v in x.tolist()]
    assert computed < 500 * 11  # the far group is never looked at


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=12), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=20), st.integers(0, 11))
def test_ties_go_to_the_smaller_number(centroids, xs, last):
    c, x = np.array(centroids), np.array(xs)
    best, least, _ = sort_means.scan(x, np.full(len(x), last % len(c)), c, *sort_means.neighbours(c))
    want = [nearest(v, centroids) for v in xs]
    assert list(zip(least.tolist(), best.tolist())) == want
    book = annular_codes.Annuli(c)
    best, least = book.nearest(x)
    assert list(zip(least.tolist(), best.tolist())) == want


def test_annuli_leave_entries_out():
    r = np.random.default_rng(2)
    entries = r.integers(-300, 300, (256, 16)) * r.integers(1, 40, (256, 1))
    x = entries[r.integers(0, 256, 400)] + r.integers(-5, 6, (400, 16))
    book = annular_codes.Annuli(entries)
    best, least = book.nearest(x)
    assert list(zip(least.tolist(), best.tolist())) == [nearest(v, entries.tolist()) for v in x.tolist()]
    assert book.computed < 400 * 60


def brute_codes(rows, parts, entries, rounds, dims):
    kept = [(r[0], r[2], ints(r[1])) for r in rows if whole(r)]
    fit, width = [k for k in kept if len(k[2]) == dims], dims // parts
    cut = lambda x: [x[p * width : (p + 1) * width] for p in range(parts)]
    books = list(zip(*[cut(x) for i, _, x in sorted((k for k in fit if k[0] is not None), key=lambda k: (k[0], k[2]))[:entries]]))
    for _ in range(rounds):
        books = [moved([cut(x)[p] for _, _, x in fit], list(books[p])) for p in range(parts)]
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = []
    for i, label, x in kept:
        near = [nearest(cut(x)[p], books[p]) for p in range(parts)] if len(x) == dims else None
        found.append((i, label, near and "".join(f"{e:02x}" for _, e in near), near and sum(d for d, _ in near)))
    total = {}
    for _, label, _, e in found:
        if e is not None:
            total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total.get(label), name) for i, label, c, e in found), key=str)


def test_codes_equal_all_distances(spark):
    rows = odd_rows(8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, annular_codes.coded(df, parts=4, entries=20, rounds=3, dims=8).collect()), key=str)
    assert got == brute_codes(rows, 4, 20, 3, 8)
    assert annular_codes.coded(df.where("false")).count() == 0
    alone = annular_codes.coded(df.where("vec_id is null"), dims=8).collect()
    assert [(r.code, r.error, r.label_error) for r in alone] == [(None, None, None)]


def test_too_large_components_end_the_job(spark):
    df = spark.createDataFrame([(1, [70000.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        sort_means.assigned(df, dims=2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_sort_means", "op13_annular_codes"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
