"""Accuracy on documents that taught nothing, on the small test tables where they are there."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, url_filter

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_quality(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality")
    got = queries.op1_quality_classifier(spark, DIR).where("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = got["score"][got["quality"] == 1].to_numpy(), got["score"][got["quality"] == 0].to_numpy()
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    assert len(bad) > 5 and auc >= 0.9


def test_language(spark):
    lang = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    got = queries.op7_language_id(spark, DIR).where("held_out and lang_pred <> 'und'").join(lang.where("lang is not null"), "doc_id")
    share = {r["lang"]: r["right"] for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert len(share) >= 4 and min(share.values()) >= 0.95, share


def test_urls_of_names_that_are_not_in_the_table(spark):
    names = {"casino-win": "block", "free-bets": "block", "cheap-pills": "block", "spam-farm": "block", "ads-track": "block", "thereof": "allow", "botany": "allow", "watchmaker": "allow", "grandmother": "allow"}
    assert not set(names) & {*url_filter.UNWANTED, *url_filter.WANTED}
    df = spark.createDataFrame([(i, f"http://www.{x}.example.net/en/7") for i, x in enumerate(names)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judged(df).collect()}
    assert [got[i] for i in range(len(names))] == list(names.values())


def test_parts_and_rules_of_urls_in_sql(spark):
    """Host, path, rule and its verdict against another engine."""
    import duckdb

    rules = sorted(url_filter.RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in rules) + " END"
    sql = f"""
        WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '{DIR}/pages.parquet'),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
        SELECT page_id, host, path, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS verdict FROM p"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op6_url_filter(spark, DIR).collect()}
    assert set(got) == set(want)
    assert all(got[i][:3] == want[i][:3] and (want[i][2] is None or got[i][3] == want[i][3]) for i in want)
