"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillon import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame, columns):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "u", "f") else str(v)
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_what_sql_gives(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_short_quotes_are_located(spark, tmp_path):
    """Quotes of one word, and of two cut at the end, stand in texts as parts of words."""
    texts = [(1, "an unbreakable sentence follows"), (2, "nothing of the kind"), (3, "some break sentences here"), (4, None)]
    quotes = [(10, "break"), (11, "break sent"), (12, "unbreakable sentence foll"), (13, "absent"), (14, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, registry.QUERIES["quote_locate"](spark, str(tmp_path)).collect()))
    assert got == sorted((i, k, t.index(q)) for i, t in texts for k, q in quotes if t and q and q in t)
