"""Tables by hash buckets of a key, changed by rewriting only the buckets that a change touches.

A row lies in the bucket ``pmod(xxhash64(key), n)``; the number of buckets is fixed when the table is
made. A merge writes the folder ``version=<v>/bucket=<b>`` for each bucket it touches, and then one
small entry that names the version of every bucket. Readers take what the newest entry names, so
they see a merge whole or not at all, and untouched buckets are neither read nor written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.sources.commits import ENTRIES, _store, publish
from trainlake.sources.readers import child_folders

BUCKETS = 256
_ENTRY = "number LONG, key STRING, buckets INT, schema STRING, versions MAP<STRING, LONG>"


@dataclass(frozen=True)
class Pointer:
    """The newest entry: its number, the key, the number of buckets, the schema, and the version of
    each bucket that has rows."""

    number: int
    key: str
    buckets: int
    schema: T.StructType
    versions: dict[int, int]


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key; rows without a key are in one, too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_pointer(spark: SparkSession, path: str) -> Pointer | None:
    folder = f"{path.rstrip('/')}/{ENTRIES}"
    store, place = _store(spark, folder)
    if not store.exists(place):
        return None
    names = sorted(s.getPath().getName() for s in store.listStatus(place))
    names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return None
    r = spark.read.schema(_ENTRY).json(f"{folder}/{names[-1]}").first()
    return Pointer(r.number, r.key, r.buckets, T.StructType.fromJson(json.loads(r.schema)), {int(b): v for b, v in r.versions.items()})


def read_buckets(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table, or the rows of some buckets; other folders are not even listed."""
    root = path.rstrip("/")
    pointer = read_pointer(spark, root)
    if pointer is None:
        raise RuntimeError(f"no bucketed table in {path}")
    wanted = pointer.versions if buckets is None else {b: pointer.versions[b] for b in buckets if b in pointer.versions}
    folders = [f"{root}/version={v}/bucket={b}" for b, v in sorted(wanted.items())]
    if not folders:
        return spark.createDataFrame([], pointer.schema)
    return spark.read.schema(pointer.schema).option("basePath", root).parquet(*folders).drop("version", "bucket")


def read_key(spark: SparkSession, path: str, value) -> DataFrame:
    """The rows of one key: one bucket is read."""
    pointer = read_pointer(spark, path)
    if pointer is None:
        raise RuntimeError(f"no bucketed table in {path}")
    kind = pointer.schema[pointer.key].dataType
    bucket = spark.range(1).select(bucket_of(F.lit(value).cast(kind), pointer.buckets)).first()[0]
    return read_buckets(spark, path, [bucket]).filter(F.col(f"`{pointer.key}`") == F.lit(value).cast(kind))


def _write(df: DataFrame, root: str, key: str, buckets: int, number: int) -> list[int]:
    """Write the buckets of ``df`` as version ``number`` and return those that have rows."""
    dealt = df.withColumn("bucket", bucket_of(F.col(f"`{key}`"), buckets)).hint("rebalance", "bucket")
    place = f"{root}/version={number}"
    dealt.sortWithinPartitions("bucket", f"`{key}`").write.mode("overwrite").partitionBy("bucket").parquet(place)
    return [int(f.partition("=")[2]) for f in child_folders(df.sparkSession, place) if f.startswith("bucket=")]


def _entry(number: int, key: str, buckets: int, schema: T.StructType, versions: dict[int, int]) -> dict:
    return {"number": number, "key": key, "buckets": buckets, "schema": schema.json(), "versions": {str(b): v for b, v in versions.items()}}


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Make the table, or replace all of it."""
    root = path.rstrip("/")
    before = read_pointer(df.sparkSession, root)
    number = before.number + 1 if before else 0
    written = _write(df, root, key, buckets, number)
    publish(df.sparkSession, root, number, _entry(number, key, buckets, df.schema, dict.fromkeys(written, number)))


def merge_buckets(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
) -> list[int]:
    """``merge(rows, changes)`` over the buckets that have a key of ``changes``, which it gives new
    rows; all others stay. Returns the touched buckets, and writes nothing if there are none.

    ``merge`` may add columns, but must leave a row in its bucket. The touched buckets are numbers
    below the table's number of buckets; that is all that passes through the driver.
    """
    root = path.rstrip("/")
    pointer = read_pointer(spark, root)
    if pointer is None:
        raise RuntimeError(f"no bucketed table in {path}")
    key = F.col(f"`{pointer.key}`").cast(pointer.schema[pointer.key].dataType)
    found = changes.select(bucket_of(key, pointer.buckets).alias("bucket")).distinct().collect()
    touched = sorted(r.bucket for r in found)
    if not touched:
        return []
    merged = merge(read_buckets(spark, root, touched), changes)
    number = pointer.number + 1
    written = _write(merged, root, pointer.key, pointer.buckets, number)
    astray = set(written) - set(touched)
    if astray:
        raise ValueError(f"the merge has moved rows to the buckets {sorted(astray)}")
    versions = {b: v for b, v in pointer.versions.items() if b not in touched} | dict.fromkeys(written, number)
    known = {f.name for f in pointer.schema.fields}
    schema = T.StructType([*pointer.schema.fields, *(f for f in merged.schema.fields if f.name not in known)])
    publish(spark, root, number, _entry(number, pointer.key, pointer.buckets, schema, versions))
    return touched


def vacuum_buckets(spark: SparkSession, path: str, older_than: timedelta = timedelta(days=7)) -> int:
    """Delete the folders of buckets that have a newer version, if they have not changed for that
    long, and return their number."""
    root = path.rstrip("/")
    pointer = read_pointer(spark, root)
    before = (datetime.now(timezone.utc) - older_than).timestamp() * 1000
    gone = 0
    for version in child_folders(spark, root):
        if not version.startswith("version="):
            continue
        store, place = _store(spark, f"{root}/{version}")
        for status in store.listStatus(place):
            name, _, bucket = status.getPath().getName().partition("=")
            if name == "bucket" and f"version={pointer.versions.get(int(bucket))}" != version and status.getModificationTime() <= before:
                store.delete(status.getPath(), True)
                gone += 1
    return gone
