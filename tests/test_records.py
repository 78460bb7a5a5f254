"""Records through their tables and back."""

from pyspark.sql import functions as F

from quillon.operators import records

SCHEMA = """id string, title string, application struct<group_id: string, group_label: string, url: string>,
    cycles array<struct<cycle_key: string, group_stated: boolean, application_group_id: string>>, evidence array<struct<id: string, q: string>>, source_refs array<struct<snapshot_id: string, raw_path: string>>"""


def rows(spark):
    return spark.createDataFrame([
        ("a", "A", ("g", "G", "u"), [("1", False, None), ("2", True, None), ("3", True, "h")], [("e", None), ("e", "q")], [("s", "p")]),
        ("b", None, None, [], None, [("s", None), ("s", None)]),
        ("c", "C", ("", None, None), None, [], None),
    ], SCHEMA)


def test_tables_give_the_records_again(spark):
    r = rows(spark)
    tables = records.taken_apart(r)
    assert sorted(map(tuple, records.assembled(tables).select(r.columns).collect())) == sorted(map(tuple, r.collect()))
    assert records.round_trip_losses(r).count() == 0
    assert sorted((m.group_id, m.cycle_key, m.id) for m in tables["members"].collect()) == [("g", "1", "a"), ("h", "3", "a")]


def test_losses_of_each_table_are_seen(spark):
    r = rows(spark)
    whole = records.taken_apart(r)
    lost = lambda **t: sorted(x.id for x in records.round_trip_losses(r, tables=whole | t).collect())
    assert lost(cycles=whole["cycles"].where("cycle_key <> '2'")) == ["a"]
    assert lost(evidence=whole["evidence"].where("q is not null")) == ["a"]
    assert lost(source_refs=whole["source_refs"].withColumn("raw_path", F.lit(None).cast("string"))) == ["a"]
    assert lost(members=whole["members"].where("group_id <> 'h'")) == ["a"]
    assert lost(opportunities=whole["opportunities"].where("id <> 'b'")) == ["b"]


def test_public_form_and_defaults(spark):
    r = rows(spark).withColumns({"version": F.lit(1), "review": F.when(F.col("id") == "a", "x")})
    shown = records.public(records.with_defaults(r, {"review": F.lit(None).cast("string"), "last_verified_at": F.lit(None).cast("string")}))
    assert "version" not in shown.columns and "last_verified_at" in shown.columns
    assert [f.name for f in shown.schema["source_refs"].dataType.elementType.fields] == ["snapshot_id"]


def test_customers_without_orders_have_empty_lists(spark, tmp_path):
    from quillon.registry import QUERIES

    at, kept = str(tmp_path), "/root/testdata/sf0.001"
    for t in ("customer", "lineitem"):
        spark.read.parquet(f"{kept}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    spark.read.parquet(f"{kept}/orders.parquet").where(F.col("o_custkey") != 7).write.parquet(f"{at}/orders.parquet")
    rows = QUERIES["record_rows"](spark, at).where("id = 7").collect()
    assert [(r.table, r.content.split("|")[1]) for r in rows] == [("opportunities", "evidence")]


def test_public_records_of_customers_without_priorities_are_those_of_sql(spark, tmp_path):
    """Without orders, or with orders of no priority, a customer has no references to show; others leave the orders of no priority out."""
    import duckdb

    from quillon.registry import QUERIES, SQL

    at, kept = str(tmp_path), "/root/testdata/sf0.001"
    for t in ("customer", "lineitem"):
        spark.read.parquet(f"{kept}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    unstated = (F.col("o_custkey") == 8) | (F.col("o_orderkey") % 3 == 0)
    orders = spark.read.parquet(f"{kept}/orders.parquet").where(F.col("o_custkey") != 7)
    orders.withColumn("o_orderpriority", F.when(~unstated, F.col("o_orderpriority"))).write.parquet(f"{at}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
    want = {r["id"]: r["refs"] for r in con.execute(SQL["public_records"]).df().to_dict("records")}
    assert {r.id: r.refs for r in QUERIES["public_records"](spark, at).collect()} == want
    assert want[7] == want[8] == "" and len(want) == 150
