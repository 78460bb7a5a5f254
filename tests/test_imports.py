"""Records merged over stored ones, and evidence attached to documents."""

import hashlib
import json

from pyspark.sql import functions as F

from quillon.functions.text import canonical, canonical_text
from quillon.operators import imports

SCHEMA = "id string, title string, cycles array<struct<cycle_key: string, v: string>>, evidence array<struct<id: string, field_path: string, v: string>>, source_refs array<struct<snapshot_id: string, v: string>>, last_fetched_at string"


def test_retained_cycles_keep_their_evidence(spark):
    old = [("a", "old", [("1", "o"), ("2", "o"), ("3~x", "o")], [("e1", "/cycles/1/amount", "o"), ("e2", "/cycles/2", "o"), ("e3", "/cycles/3~0x/amount", "o"), ("e4", "/title", "o"), ("n1", "/cycles/1", "o")], [("s1", "o"), ("s2", "o")], "2026-02-01"), ("b", "only", [], [], [], "2026-01-01"), ("n", "nulls", None, None, None, None)]
    new = [("a", "new", [("4", "n"), ("2", "n")], [("n1", "/cycles/2", "n")], [("s2", "n"), ("s3", "n")], "2026-01-15"), ("c", "first", [("1", "n")], None, None, None), ("n", "again", [("1", "n")], [("x", "/", "n")], [("s", "n")], "2026-03-01"), ("gone", "x", None, None, None, None)]
    stored, coming = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    got = {r.id: r for r in imports.merged_records(stored, coming, superseded=spark.createDataFrame([("gone",), ("gone",)], "id string")).collect()}
    assert set(got) == {"a", "b", "c", "n"}
    a = got["a"]
    assert (a.title, a.action, a.last_fetched_at) == ("new", "merged", "2026-02-01")
    assert [(c.cycle_key, c.v) for c in a.cycles] == [("1", "o"), ("2", "n"), ("3~x", "o"), ("4", "n")]
    assert [(e.id, e.v) for e in a.evidence] == [("n1", "n"), ("e1", "o"), ("e3", "o")]  # e2's cycle came again, e4 is of no cycle, n1 came
    assert [(s.snapshot_id, s.v) for s in a.source_refs] == [("s1", "o"), ("s2", "n"), ("s3", "n")]
    assert got["b"].action == "retained" and got["c"].action == "created" and got["c"].evidence is None
    assert got["n"].cycles[0].v == "n" and got["n"].last_fetched_at == "2026-03-01"


def test_a_record_that_comes_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("a", "t", [("1", "o")], [("e", "/cycles/1", "o")], [("s", "o")], "2026-01-01")], SCHEMA)
    once = imports.merged_records(rows, rows).drop("action")
    assert once.collect() == rows.select(once.columns).collect()


def test_markers_become_ids(spark):
    quote = lambda q, s=None: {"quote": q, **({"snapshot": s} if s else {})}
    document = {"evidence_ids": [quote("top")], "application": {"evidence_ids": ["kept", quote("a  é")], "note": [quote("no field of evidence")]}, "cycles": [{"cycle_key": "k/1", "starts_on": None, "window_evidence_ids": [quote("w", "other")], "deadlines": [{"evidence_ids": [quote("d"), quote("d"), quote("x", "unknown")]}]}]}
    rows = spark.createDataFrame([(1, "own", json.dumps(document)), (2, "own", "{}"), (3, "own", None)], "k int, own string, d string")
    names = spark.createDataFrame([("own", "S1"), ("other", "S2")], "snapshot string, snapshot_id string")
    docs, evidence = imports.attached(rows, names, "k", "d", "own")
    made = {r.k: r.d for r in docs.collect()}
    ids = lambda p, s, q: hashlib.sha256("\x1f".join([p, s, q]).encode()).hexdigest()[:16]
    want = json.loads(json.dumps(document))
    want["evidence_ids"] = [ids("", "S1", "top")]
    want["application"]["evidence_ids"] = ["kept", ids("/application", "S1", "a é")]
    cycle = want["cycles"][0]
    cycle["window_evidence_ids"] = [ids("/cycles/k~11/ends_on", "S2", "w")]
    d = ids("/cycles/k~11/deadlines/0", "S1", "d")
    cycle["deadlines"][0]["evidence_ids"] = [d, d, None]
    assert json.loads(made[1]) == want and made[2] == "{}" and made[3] is None
    found = {r.id: (r.field_path, r.snapshot_id, r.quote) for r in evidence.collect()}
    assert len(found) == 4 and found[d] == ("/cycles/k~11/deadlines/0", "S1", "d")


def test_snapshots_of_several_names_give_evidence_once(spark):
    document = {"evidence_ids": [{"quote": " a"}, {"quote": "a", "snapshot": "own"}, {"quote": "a", "snapshot": "alias"}, {"quote": "b", "snapshot": "alias"}, {"quote": 7}]}
    rows = spark.createDataFrame([(1, "own", json.dumps(document)), (2, "own", json.dumps(document)), (3, None, json.dumps(document))], "k int, own string, d string")
    alone = spark.createDataFrame([("own", "S"), (None, "S"), ("gone", None)], "snapshot string, snapshot_id string")
    alias = alone.union(spark.createDataFrame([("alias", "S"), ("own", "S")], alone.schema))
    got = lambda names: sorted((r.k, r.quote) for r in imports.attached_evidence(rows, names, "k", "d", "own").collect())
    assert got(alone) == [(1, "7"), (1, "a"), (2, "7"), (2, "a"), (3, "a")]
    assert got(alias) == [(1, "7"), (1, "a"), (1, "b"), (2, "7"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]


def test_evidence_is_not_shuffled_by_its_ids(spark):
    """Documents are whole where they are read, so markers that repeat others go there, and none is sorted by key and id."""
    rows = spark.createDataFrame([(1, "own", "{}")], "k int, own string, d string")
    names = spark.createDataFrame([("own", "S1"), ("other", "S2")], "snapshot string, snapshot_id string")
    plan = imports.attached_evidence(rows, names, "k", "d", "own")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "ArrowEvalPython" not in plan


def test_canonical_text_is_canonical(spark):
    odd = ["", " ", "a  b", " a\tb\n", "\x1ca\x1db", "a\x0bb\x85c\xa0d", "‘x’ “y” –z−", "ｔｅ­xt​", "é é", " 　x ", "a\x00b", "½ ﬁ", "\U0001f600 \x7f", "﻿a ﻿ b "]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", canonical(F.col("x")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: canonical_text(x) for i, x in enumerate(odd)}


def test_only_names_of_snapshots_travel(spark):
    """What is shuffled for documents is a row for each snapshot that one cites: no path, no quote, and no id of a marker."""
    rows = spark.createDataFrame([(1, "own", "{}")], "k int, own string, d string")
    names = spark.createDataFrame([("own", "S1")], "snapshot string, snapshot_id string")
    plan = imports.attached_documents(rows, names, "k", "d", "own")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "field_path" not in plan and "sha2" not in plan


def test_odd_names_of_snapshots_are_read(spark):
    """Names with escapes, keys that are escaped, names that are no strings, the word as a value, names that are listed twice."""
    texts = [
        '{"evidence_ids": [{"quote": "a", "snapshot": "two\\u0020words"}, {"quote": "b", "snapshot" : "x\\"y"}]}',
        '{"evidence_ids": [{"quote": "a", "snap\\u0073hot": "one"}, {"quote": "b"}]}',
        '{"evidence_ids": [{"quote": 7, "snapshot": 7}, {"quote": "t", "snapshot": true}, {"quote": "n", "snapshot": null}, {"quote": "e", "snapshot": ""}]}',
        '{"snapshot": "snapshot", "evidence_ids": [{"quote": "snapshot", "snapshot":"one"}, {"quote": "s", "snapshot":"snapshot"}]}',
        '{"a/b~": [[{"evidence_ids": [{"quote": "deep", "snapshot": "twice"}, {"quote": "gone", "snapshot": "lost"}, {"quote": "null", "snapshot": "empty"}]}]]}',
    ]
    rows = spark.createDataFrame([(i, "own" if i != 1 else None, t) for i, t in enumerate(texts)] + [(None, "own", texts[1]), (9, "own", None)], "k int, own string, d string")
    ids = {"two words": "A", 'x"y': "B", "one": "C", "own": "D", "7": "E", "True": "F", "": "G", "snapshot": "H", "twice": "I"}
    names = spark.createDataFrame([*ids.items(), ("twice", "J"), ("empty", None), (None, "K"), ("unused", "L")], "snapshot string, snapshot_id string")
    made = {r.k: r.d for r in imports.attached_documents(rows, names, "k", "d", "own").collect()}
    id_of = lambda p, s, q: hashlib.sha256("\x1f".join([p, ids[s], q]).encode()).hexdigest()[:16]
    got = {k: json.loads(d) for k, d in made.items() if d is not None and k is not None}
    assert got[0]["evidence_ids"] == [id_of("", "two words", "a"), id_of("", 'x"y', "b")]
    assert got[1]["evidence_ids"] == [id_of("", "one", "a"), None]
    assert got[2]["evidence_ids"] == [id_of("", "7", "7"), id_of("", "True", "t"), id_of("", "own", "n"), id_of("", "", "e")]
    assert got[3]["evidence_ids"] == [id_of("", "one", "snapshot"), id_of("", "snapshot", "s")]
    assert got[4]["a/b~"][0][0]["evidence_ids"] == [id_of("/a~1b~0/0/0", "twice", "deep"), None, None]
    assert made[9] is None and len(made) == 7
