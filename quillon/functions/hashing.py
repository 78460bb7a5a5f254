"""Content hashes, ids made of them, and canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def snapshot_id(content: Column) -> Column:
    return F.concat(F.lit("snap_"), F.substring(sha256(content), 1, 20))


def evidence_id(field_path: Column, snapshot: Column, quote: Column) -> Column:
    """From the place, the snapshot and the quote in canonical text."""
    return F.substring(sha256(F.concat_ws("\u001f", field_path, snapshot, quote)), 1, 16)


def evidence_id_of(field_path: str, snapshot: str, quote: str) -> str:
    """What ``evidence_id`` gives, for values that are in Python already."""
    return hashlib.sha256("\x1f".join((field_path, snapshot, quote)).encode()).hexdigest()[:16]


def row_fingerprint(*values: Column) -> Column:
    """16 digits of a hash of the values; a null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("")) for v in values))), 1, 16)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys, no spaces and its characters as they are; null where it can't be read."""

    def one(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


def fingerprint(document: Column) -> Column:
    """Of a JSON document, whatever the order of its keys."""
    return sha256(canonical_json(document))


@F.pandas_udf(T.BooleanType())
def has_duplicate_keys(s: pd.Series) -> pd.Series:
    """Whether any object of a JSON document names a key twice; false where it can't be read."""

    def one(text):
        twice = []

        def pairs(items):
            twice.append(len({k for k, _ in items}) < len(items))
            return None

        try:
            json.loads(text, object_pairs_hook=pairs)
        except ValueError:
            return False
        return any(twice)

    return s.map(one, na_action="ignore")
