"""Records that come in again, merged into the stored ones: nested cycles, evidence and source references, within the row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import evidence_id, evidence_id_of
from ..functions.text import canonical_text
from .pointers import cycle_of

# Fields that hold evidence, and the field that each speaks for (none: the object itself).
EVIDENCE_FIELDS = {"evidence_ids": (), "group_evidence_ids": ("application_group_id",), "window_evidence_ids": ("starts_on", "ends_on")}


def by_key(old: Column, new: Column, key: str) -> Column:
    """Items of two arrays of structs by a key: the old ones in their order, each replaced by its new one, then the new ones that are new."""
    same = lambda a, b: a[key].eqNullSafe(b[key])
    replaced = F.transform(old, lambda o: F.coalesce(F.get(F.filter(new, lambda n: same(n, o)), 0), o))
    return F.concat(replaced, F.filter(new, lambda n: ~F.exists(old, lambda o: same(n, o))))


def retained_evidence(old_evidence: Column, new_evidence: Column, old_cycles: Column, new_cycles: Column) -> Column:
    """The new evidence, then the old one of cycles that did not come again, but for ids that the new one has."""
    keys = lambda cycles: F.transform(cycles, lambda c: c.cycle_key)
    gone = F.array_except(keys(old_cycles), keys(new_cycles))
    held = F.transform(new_evidence, lambda e: e.id)
    return F.concat(new_evidence, F.filter(old_evidence, lambda e: F.coalesce(F.array_contains(gone, cycle_of(e.field_path)), F.lit(False)) & ~F.array_contains(held, e.id)))


def merged_records(stored: DataFrame, incoming: DataFrame, key: str = "id", superseded: DataFrame | None = None) -> DataFrame:
    """Stored records with those that come in merged over them, one row for each id, and ``action``: created, merged, retained.

    Both have the same columns, among them cycles, evidence, source_refs (arrays of structs with cycle_key; id and field_path;
    snapshot_id) and last_fetched_at. Fields of the incoming record win; cycles that only the stored one has stay with their
    evidence; references are joined by snapshot; the later fetch counts. superseded (the key): ids that this run replaced by
    others; they don't come in, and what is stored of them stays.
    """
    if superseded is not None:
        incoming = incoming.join(superseded.select(key).distinct(), key, "left_anti")
    columns = [c for c in incoming.columns if c != key]
    j = stored.select(key, F.struct(*columns).alias("o")).join(incoming.select(key, F.struct(*columns).alias("n")), key, "full")
    empty = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.array().cast(dict(incoming.dtypes)[c]))
    oc, nc, oe, ne = (empty(s, c) for c in ("cycles", "evidence") for s in ("o", "n"))
    both = {
        "cycles": by_key(oc, nc, "cycle_key"),
        "evidence": retained_evidence(oe, ne, oc, nc),
        "source_refs": by_key(empty("o", "source_refs"), empty("n", "source_refs"), "snapshot_id"),
        "last_fetched_at": F.greatest("o.last_fetched_at", "n.last_fetched_at"),
    }
    is_new, is_old = F.col("n").isNotNull(), F.col("o").isNotNull()
    pick = lambda c: F.when(is_new & is_old, both.get(c, F.col(f"n.{c}"))).otherwise(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
    return j.select(key, *map(pick, columns), F.when(~is_old, "created").when(is_new, "merged").otherwise("retained").alias("action"))


def _escaped(token: object) -> str:
    token = str(token)
    return "/" + (token.replace("~", "~0").replace("/", "~1") if "~" in token or "/" in token else token)


def _places(node, path: str, out: list) -> list[tuple]:
    """Markers (objects with quote) in the evidence fields of a document's object or list, in order: the list that holds each, its place there, and the path that it speaks for."""
    if type(node) is dict:
        for name, value in node.items():
            kind = type(value)
            if kind is list and name in EVIDENCE_FIELDS:
                target = None
                for i, item in enumerate(value):
                    if type(item) is dict and "quote" in item:
                        if target is None:
                            own = EVIDENCE_FIELDS[name]
                            target = path + (_escaped(next((f for f in own if node.get(f)), own[-1])) if own else "")
                        out.append((value, i, target))
            elif value and (kind is dict or kind is list):
                _places(value, path + _escaped(name), out)
    elif type(node) is list:
        keyed = path == "/cycles"
        for i, v in enumerate(node):
            kind = type(v)
            if kind is dict:
                _places(v, path + _escaped(v["cycle_key"]) if keyed and "cycle_key" in v else f"{path}/{i}", out)
            elif kind is list:
                _places(v, f"{path}/{i}", out)
    return out


#: Markers that are passed on at once.
AT_ONCE = 1 << 14


def _markers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each marker of documents (key, own snapshot, document), without those that repeat an earlier one's path, snapshot and canonical quote."""
    for batch in batches:
        rows, found = [], []

        def table():
            columns = zip(*found)  # noqa: B023
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(next(columns), pa.int32()), *(pa.array(c, pa.string()) for c in columns)], names=[batch.schema.names[0], "at", "field_path", "quote", "plain", "snapshot"])  # noqa: B023

        for row, (own, text) in enumerate(zip(batch.column(1), batch.column(2))):
            if (text := text.as_py()) is None:
                continue
            own, seen = own.as_py(), set()
            for at, (items, i, path) in enumerate(_places(json.loads(text), "", [])):
                quote, snapshot = str(items[i]["quote"]), items[i].get("snapshot")
                same = path, canonical_text(quote), own if snapshot is None else str(snapshot)
                if same not in seen:
                    seen.add(same)
                    rows.append(row)
                    found.append((at, path, quote, *same[1:]))
            if len(rows) >= AT_ONCE:
                yield table()
                rows, found = [], []
        if rows:
            yield table()


_STATED = re.compile(r'"snapshot"\s*:\s*"([^"]*)"')


def _snapshots(text: str) -> set[str]:
    """Names of the snapshots that a document's markers cite, perhaps with others."""
    if "\\" not in text:  # then a string ends at the next quotation mark
        stated = _STATED.findall(text)
        if len(stated) == text.count('"snapshot"'):
            return set(stated)
    names = set()
    json.loads(text, object_hook=lambda x: names.add(str(x["snapshot"])) if x.get("snapshot") is not None else None)
    return names


def _cited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (key, own snapshot, document) and snapshot that it may cite."""
    for batch in batches:
        rows, names = [], []
        for row, (own, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
            if (text := text.as_py()) is not None:
                cited = _snapshots(text) | ({own} if own is not None else set())
                rows.extend([row] * len(cited))
                names.extend(cited)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], names=[batch.schema.names[0], "snapshot"])


_written = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


@F.arrow_udf(T.StringType())
def _replaced(documents: pa.Array, own: pa.Array, names: pa.Array, ids: pa.Array) -> pa.Array:
    """Documents with evidence ids in their markers' places; names and ids: the known ones of the snapshots that each cites."""

    def one(text, own, names, ids):
        if text is None:
            return None
        known = dict(zip(names, ids))
        if len(known) < len(names):  # a name that is listed twice stands for its least id
            known = dict(sorted(zip(names, ids), reverse=True))
        document = json.loads(text)
        for items, i, path in _places(document, "", []):
            marker = items[i]
            snapshot = marker.get("snapshot")
            found = known.get(own if snapshot is None else str(snapshot))
            items[i] = None if found is None else evidence_id_of(path, found, canonical_text(str(marker["quote"])))
        return _written(document)

    # Lists come flat: taking each out of Arrow costs more than the work on it.
    ends = np.cumsum(pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False)).tolist()
    plain = lambda a: a.to_numpy(zero_copy_only=False).tolist()
    names, ids = plain(names.flatten()), plain(ids.flatten())
    texts = (x.as_py() for x in documents)  # one at a time
    return pa.array([one(text, mine, names[a:b], ids[a:b]) for text, mine, a, b in zip(texts, plain(own), [0, *ends], ends)], pa.string())


def _asked(records: DataFrame, key: str, document: str, primary: str) -> DataFrame:
    return records.select(key, F.col(primary).cast("string"), F.col(document).cast("string"))


def attached_documents(records: DataFrame, snapshots: DataFrame, key: str, document: str, primary: str) -> DataFrame:
    """The records of ``attached``. Only the names of cited snapshots travel, each once for a document; documents are read and rewritten in place, where their ids are made."""
    kind = dict(records.dtypes)[key]
    cited = _asked(records, key, document, primary).mapInArrow(_cited, f"`{key}` {kind}, snapshot string")
    known = cited.join(snapshots.select("snapshot", "snapshot_id").where("snapshot_id is not null"), "snapshot")
    found = known.groupBy(key).agg(F.collect_list(F.struct("snapshot", "snapshot_id")).alias("_known"))
    ids = _replaced(F.col(document).cast("string"), F.col(primary).cast("string"), F.col("_known.snapshot"), F.col("_known.snapshot_id"))
    return records.join(found, key, "left").withColumn(document, ids).drop("_known")


def attached_evidence(records: DataFrame, snapshots: DataFrame, key: str, document: str, primary: str) -> DataFrame:
    """The evidence of ``attached``.

    Markers that repeat others of their document are left out where the document is read. What is left has the same id twice
    only where a snapshot goes by several names (or is listed twice); only then markers are grouped by key and id.
    """
    known = snapshots.where("snapshot is not null and snapshot_id is not null")
    each = _asked(records, key, document, primary).mapInArrow(_markers, f"`{key}` {dict(records.dtypes)[key]}, at int, field_path string, quote string, plain string, snapshot string")
    made = evidence_id(F.col("field_path"), F.col("snapshot_id"), F.col("plain")).alias("id")
    named = each.join(known.select("snapshot", "snapshot_id"), "snapshot").select(key, "at", made, "field_path", "snapshot_id", F.trim("quote").alias("quote"))
    if known.groupBy("snapshot_id").count().where("count > 1").isEmpty():
        return named.select(key, "id", "field_path", "snapshot_id", "quote")
    return named.groupBy(key, "id").agg(F.min_by(F.struct("field_path", "snapshot_id", "quote"), "at").alias("e")).select(key, "id", "e.*")


def attached(records: DataFrame, snapshots: DataFrame, key: str, document: str, primary: str) -> tuple[DataFrame, DataFrame]:
    """Records whose documents (JSON) cite quotes by markers, ``{"quote": ..., "snapshot": ...}``, with these replaced by evidence ids; and the evidence: (key, id, field_path, snapshot_id, quote), each once.

    A marker without a snapshot means the record's own (the column ``primary``). snapshots: snapshot, snapshot_id; key: one
    record each. A marker of an unknown snapshot becomes null and gives no evidence.
    """
    return attached_documents(records, snapshots, key, document, primary), attached_evidence(records, snapshots, key, document, primary)
