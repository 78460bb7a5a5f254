"""Repeated and null ids, ties, a text over four megabytes, and columns whose names the operators use themselves."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, paragraph_dedup, quality_fm, quality_rules, url_filter

SAME = "one two three four five six seven eight nine ten eleven twelve"


def long_text():
    r = random.Random(77)
    words = [f"w{i}" for i in range(3000)]
    return "\n".join(" ".join(r.choice(words) for _ in range(100)) for _ in range(9000))


LONG = long_text()
PAIRS = [(1, SAME), (1, SAME), (1, "other words stand here in this row of their own"), (None, SAME), (None, None), (2, ""), (3, LONG), (3, None), (4, LONG + " end"), (5, SAME + "\n" + SAME), (6, "\t")]
CLASHING = "epoch upto label score node comp kept row sig a b n tokens text_key start key first place want before inside bin _domain _lang _source".split()


@pytest.fixture(scope="module")
def rows(spark):
    assert len(LONG) > 4 << 20
    df = spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(PAIRS)], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.repartition(2).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df.cache()


@pytest.fixture(scope="module")
def few_labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int")


def test_rows_are_scored_each(rows, few_labels):
    assert sorted(str(r.doc_id) for r in quality_fm.scored(rows, few_labels).collect()) == sorted(str(i) for i, _ in PAIRS)
    kept = quality_fm.kept(rows, few_labels.where("false"))
    assert kept.columns == rows.columns and kept.count() == len(PAIRS)
    got = quality_rules.judged(rows, few_labels).collect()
    assert len(got) == len(PAIRS) and sorted(r.n_words for r in got) == sorted(len(brute.words(t)) for _, t in PAIRS)
    got = language_id.identified(rows, 3).collect()
    assert len(got) == len(PAIRS) and sum(r.lang_pred == "und" for r in got) == 4


def test_mixing_keeps_columns_and_rows_together(rows):
    every = mixing.selected(rows, 1.0)
    assert every.columns == rows.columns and every.count() == len(PAIRS) and every.where("epoch = 'own epoch' and upto = 'own upto' and _domain = 'own _domain'").count() == len(PAIRS)
    some = mixing.selected(rows, 0.3)
    assert some.columns == rows.columns and some.count() <= len(PAIRS)
    by_leaf = some.groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect()
    whole = {(r.source, r.doc_id): r.n for r in rows.groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(whole[r.source, r.doc_id] == r.n for r in by_leaf)


def test_sets_of_repeated_ids(rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components_of(rows).collect()), key=str)
    size = lambda t: len(brute.shingle_set(t))
    least = {1: 1, None: None, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}
    assert got == sorted(((i, size(t), least[i]) for i, t in PAIRS), key=str)
    kept = ngram_join.deduplicated(rows)
    assert kept.columns == rows.columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(i) for i, _ in PAIRS if i != 4)


def test_lines_and_passages_of_repeated_ids(rows):
    got = {r.doc_id: (r.n_lines, list(r.removed_lines)) for r in line_dedup.deduplicated(rows).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[2] == got[6] == (0, []) and got[1] == (1, []) and got[5] == (2, [0, 1]) and got[3] == (9000, []) and got[4] == (9000, list(range(9000)))
    passages = [(r.doc_id, r.start, r.n_words, r.cluster_id, r.n_removed) for r in paragraph_dedup.repeated(rows).collect()]
    n = len(brute.words(LONG))
    assert sorted(passages) == [(3, 0, n, 3, 0), (4, 0, n + 1, 3, n + 1)] or sorted(passages) == [(3, 0, n, 3, 0), (4, 0, n, 3, n)]


def test_texts_and_pieces_of_repeated_ids(rows):
    got = [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.identities(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 3), (1, 1, 3), (1, 1, 1), (None, 1, 3), (None, 2, 3), (2, 2, 3), (3, 3, 1), (3, 2, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1)], key=str)
    pieces = packing.packed(rows, shard_bytes=1 << 20).collect()
    by_sequence: dict = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by_sequence.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= 4096
    assert sum(r.length for r in pieces if r.doc_id == 4) == next(r.doc_tokens for r in pieces if r.doc_id == 4)
    assert sum(r.length for r in pieces if r.doc_id is None) == sum({r.doc_tokens for r in pieces if r.doc_id is None})


def test_pages_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None), (2, "http://" + "b" * 100_000 + ".net/")], "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "verdict", "score")})
    got = sorted((str(r.page_id), r.verdict) for r in url_filter.judged(df).collect())
    assert [x[0] for x in got] == ["1", "1", "2", "None"] and got[0] == got[1] == ("1", "allow")


def test_equal_scores_go_by_order():
    docs = [np.array([1, 2, 2], "<u4")] * 5
    assert packing.windows_of(docs, 6) == [[(0, 0, 3), (1, 0, 3)], [(2, 0, 3), (3, 0, 3)], [(4, 0, 3)]]


def test_pipeline_run_is_its_stages(spark, docs, labels, tmp_path):
    """run() gives what the stages give one by one, every kept document is packed whole, and empty tables give no rows."""
    import corpus_pipeline

    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "none").mkdir()
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.where("false").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = now
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got, want = (sorted(map(tuple, df.select(columns).collect()), key=str) for df in (corpus_pipeline.run(spark, str(tmp_path)), now))
    assert got == want and {r[0] for r in got} == {r.doc_id for r in last.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
