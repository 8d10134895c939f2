"""Comparison of a Spark result with the rows of an SQL engine."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

from checkset.tables import NAMES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Numbers of equal value compare equal; everything else keeps its type."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return value.normalize() + 0
    if isinstance(value, float):
        return "nan" if value != value else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
    "string": "text", "varchar": "text", "timestamp_ntz": "timestamp", "float": "double",
    '"null"': "null", "void": "null",
}


def kind(name: str) -> str:
    name = name.lower().split("(")[0]
    return KINDS.get(name, name)


def rows_by_name(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when columns, kinds of type and all values agree; else a short report."""
    cursor = con.execute(sql)
    want_names = [c[0] for c in cursor.description]
    want_kinds = {c[0]: kind(str(c[1])) for c in cursor.description}
    want_rows = cursor.fetchall()
    have_kinds = {n: kind(t) for n, t in df.dtypes}
    nested = {n: t for n, t in df.dtypes if t.startswith(("decimal", "array", "map", "struct")) or t in ("timestamp", "date")}
    if nested:
        return f"types that other engines print differently: {nested}"
    if sorted(want_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    odd = {n: (have_kinds[n], want_kinds[n]) for n in want_names if have_kinds[n] != want_kinds[n]}
    odd = {n: k for n, k in odd.items() if "null" not in k}
    if odd:
        return f"types differ (ours, theirs): {odd}"
    have = rows_by_name(df.columns, df.collect())
    want = rows_by_name(want_names, want_rows)
    if have == want:
        return None
    extra, lost = list((have - want).items())[:3], list((want - have).items())[:3]
    return f"rows {sum(have.values())} vs {sum(want.values())}; only ours {extra}; only theirs {lost}"
