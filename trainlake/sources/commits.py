"""Tables that grow by commits, and the ledger of the files they have consumed.

A table is a folder. Each load writes the folder ``commit=<name>`` with its rows, then
``_ledger/commit=<name>`` with the files it has read, and last one small entry in ``_commits``.
Only what an entry names counts: a load that dies before its entry leaves nothing behind that a
reader sees, and the next one reads the same files again. An entry may replace earlier ones, as a
rebuild or a compaction does.

Batch jobs and streams share this layout, so they can take turns on one table; a file is loaded
by the one that commits it first. One writer at a time: a second one that takes the same number
is refused.

A file is known by its path, length and change time. One that was written again under its old
name is a new delivery.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.session import scratch_path
from trainlake.sources.writers import clustered, ranged

ENTRIES, LEDGER = "_commits", "_ledger"
LEDGER_SCHEMA = "file STRING, length LONG, changed TIMESTAMP"
#: The commit that loaded a row; a column of the files, so that compaction keeps it.
LOADED_BY = "load_batch"
MAX_FILES = 100_000


@dataclass(frozen=True)
class Commit:
    """One entry: its number and name, the rows and files, the schema of its rows, and the names of
    the earlier commits that it replaces (``["*"]``: all)."""

    number: int
    name: str
    rows: int
    files: int
    schema: str
    replaces: tuple[str, ...] = ()
    loaded: bool = True
    written_at: str = ""


_ENTRY = "number LONG, name STRING, rows LONG, files LONG, schema STRING, replaces ARRAY<STRING>, loaded BOOLEAN, written_at STRING"


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_commits(spark: SparkSession, path: str) -> list[Commit]:
    """All entries in order; none where there is no table. They are few and small: names and
    figures, no data."""
    folder = f"{path.rstrip('/')}/{ENTRIES}"
    store, place = _store(spark, folder)
    if not store.exists(place):
        return []
    found = spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json").json(folder).collect()
    return sorted((Commit(**{**r.asDict(), "replaces": tuple(r.replaces or ())}) for r in found), key=lambda c: c.number)


def live_commits(commits: Sequence[Commit]) -> list[Commit]:
    """The commits that no later one has replaced."""
    live: list[Commit] = []
    for c in commits:
        gone = set(c.replaces)
        live = [] if "*" in gone else [x for x in live if x.name not in gone]
        live.append(c)
    return live


def merged_schema(commits: Sequence[Commit]) -> T.StructType:
    """The columns of all commits, in order of appearance."""
    fields: dict[str, T.StructField] = {}
    for c in commits:
        for f in T.StructType.fromJson(json.loads(c.schema)).fields:
            fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(fields.values()))


def read_committed(spark: SparkSession, path: str, loaded_by: bool = False) -> DataFrame:
    """The rows of all live commits; columns that a commit lacks are null. The schema comes from the
    entries, so no file is opened for it. ``loaded_by`` keeps the name of the load in ``load_batch``."""
    root = path.rstrip("/")
    live = live_commits(read_commits(spark, root))
    if not live:
        raise RuntimeError(f"no commit in {path}")
    schema = merged_schema(live)
    folders = [f"{root}/commit={c.name}" for c in live if c.rows]
    if not folders:
        df = spark.createDataFrame([], schema)
    else:
        df = spark.read.schema(schema).option("basePath", root).parquet(*folders).drop("commit")
    return df if loaded_by else df.drop(LOADED_BY)


def publish(spark: SparkSession, root: str, number: int, payload: dict) -> None:
    """Write entry ``number`` of a table in one step: a reader sees all of it or nothing. Taken
    numbers are refused."""
    store, place = _store(spark, f"{root}/{ENTRIES}/{number:012d}.json")
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{ENTRIES}/.{uuid.uuid4().hex}.tmp")
    taken = f"another writer has made commit {number} of {root}"
    if store.exists(place):
        raise RuntimeError(taken)
    out = store.create(hidden, True)
    out.write(bytearray(json.dumps(payload).encode()))
    out.close()
    if not store.rename(hidden, place):
        raise RuntimeError(taken)


def loads(spark: SparkSession, path: str) -> list[str]:
    """Names of the loads whose rows are in the table, in order, also of those compacted since."""
    commits = read_commits(spark, path)
    last = max((k for k, c in enumerate(commits) if "*" in c.replaces), default=0)
    return [c.name for c in commits[last:] if c.loaded]


def read_load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one load: its own folder, or once it is compacted, the rewritten ones, whose file
    statistics find it."""
    root = path.rstrip("/")
    live = live_commits(read_commits(spark, root))
    schema = merged_schema(live)
    own = [c for c in live if c.name == name] or [c for c in live if not c.loaded]
    folders = [f"{root}/commit={c.name}" for c in own if c.rows]
    if not folders:
        return spark.createDataFrame([], schema).drop(LOADED_BY)
    df = spark.read.schema(schema).option("basePath", root).parquet(*folders).drop("commit")
    return df.filter(F.col(LOADED_BY) == name).drop(LOADED_BY)


def _publish(spark: SparkSession, root: str, entry: Commit) -> None:
    publish(spark, root, entry.number, asdict(entry))


def commit_rows(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    ranged_by: Sequence[str] = (),
    files: DataFrame | None = None,
    name: str | None = None,
    replaces: Sequence[str] = (),
    loaded: bool = True,
) -> Commit | None:
    """Write ``df`` as one commit of the table ``path``, with the ``files`` (``file, length, changed``)
    it comes from. Rows are counted while they are written.

    A commit of that ``name`` that exists already is left as it is, and None returned: a stream
    batch that runs again counts once. A column that changed its type is refused before anything
    is published. ``replaces`` names commits that the new one stands for. ``loaded=False`` keeps
    the rows' own ``load_batch``, as a rewrite does.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    before = read_commits(spark, root)
    number = before[-1].number + 1 if before else 0
    name = name or f"b{number:012d}"
    if any(c.name == name for c in before):
        return None
    if loaded:
        df = df.withColumn(LOADED_BY, F.lit(name))
    kept = [] if "*" in replaces else [c for c in live_commits(before) if c.name not in replaces]
    types = {f.name: f.dataType.simpleString() for f in merged_schema(kept).fields}
    for f in df.schema.fields:
        if types.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, in the table it is {types[f.name]}")
    seen = Observation()
    if ranged_by:
        out = ranged(df, ranged_by)
    elif partition_by:
        out = clustered(df, partition_by, partition_by)
    else:
        out = df
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/commit={name}")
    n_files = 0
    if files is not None:
        taken = Observation()
        place = f"{root}/{LEDGER}/commit={name}"
        files.select("file", "length", "changed").observe(taken, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(place)
        n_files = taken.get["n"]
    stamp = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    entry = Commit(number, name, seen.get["n"], n_files, df.schema.json(), tuple(replaces), loaded, stamp)
    _publish(spark, root, entry)
    return entry


def consumed_files(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of the table: the files of all commits since the last rebuild. A compaction
    replaces rows, not what was read."""
    root = path.rstrip("/")
    commits = read_commits(spark, root)
    last = max((k for k, c in enumerate(commits) if "*" in c.replaces), default=0)
    folders = [f"{root}/{LEDGER}/commit={c.name}" for c in commits[last:] if c.files]
    if not folders:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(*folders)


def listed_files(spark: SparkSession, prefix: str, glob: str = "*.parquet", exclude: str | None = None) -> DataFrame:
    """``path, file, length, changed`` of the files below ``prefix``; contents stay unread. ``file``
    is the path as readers report it. ``exclude`` is a file, or the folder of that name that a
    Spark write makes. A missing folder has no files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    try:
        files = reader.load(prefix)
    except AnalysisException:
        return spark.createDataFrame([], f"path STRING, {LEDGER_SCHEMA}")
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("changed")]
    found = files.select("path", *meta)
    return found if exclude is None else found.filter(~F.col("path").rlike(f"/{re.escape(exclude)}(/[^/]*)?$"))


def new_files(spark: SparkSession, prefix: str, path: str, glob: str = "*.parquet", exclude: str | None = None, most: int | None = MAX_FILES) -> DataFrame:
    """The files below ``prefix`` that the table ``path`` has not consumed, whatever day their
    folders are named for; the oldest ``most`` of them."""
    found = listed_files(spark, prefix, glob, exclude).join(consumed_files(spark, path), ["file", "length", "changed"], "left_anti")
    return found if most is None else found.orderBy("changed", "file").limit(most)


def pinned(files: DataFrame) -> DataFrame:
    """A listing that does not change any more: what is read and what the ledger gets must be the
    same files, also when more arrive in between."""
    spark = files.sparkSession
    place = scratch_path(spark, "listing")
    files.write.parquet(place)
    return spark.read.schema(files.schema).parquet(place)


def file_names(files: DataFrame) -> list[str]:
    """Paths for a reader. They are patterns to it, so signs with a meaning there are masked."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.path) for r in files.select("path").collect()]


def compact(spark: SparkSession, path: str, target_bytes: int = 1 << 30, partition_by: Sequence[str] = (), ranged_by: Sequence[str] = ()) -> list[Commit]:
    """Rewrite small commits together, so that daily loads and stream batches do not pile up files.

    Commits below ``target_bytes`` are dealt to bins of at most that size, each to the first bin
    that has room; a bin of several becomes one commit that replaces them. Rows, ``load_batch``
    and the ledger stay; the old folders stay too until ``vacuum``.
    """
    root = path.rstrip("/")
    live = [c for c in live_commits(read_commits(spark, root)) if c.rows]
    store, _ = _store(spark, root)
    sizes = {c.name: store.getContentSummary(_store(spark, f"{root}/commit={c.name}")[1]).getLength() for c in live}
    bins: list[list[Commit]] = []
    room: list[int] = []
    for c in live:
        if sizes[c.name] >= target_bytes:
            continue
        at = next((k for k, free in enumerate(room) if free >= sizes[c.name]), None)
        if at is None:
            bins.append([])
            room.append(target_bytes)
            at = len(bins) - 1
        bins[at].append(c)
        room[at] -= sizes[c.name]
    out = []
    for members in bins:
        if len(members) < 2:
            continue
        schema = merged_schema(members)
        df = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/commit={c.name}" for c in members]).drop("commit")
        made = commit_rows(df, root, partition_by, ranged_by, replaces=[c.name for c in members], loaded=False)
        if made is not None:
            out.append(made)
    return out


def vacuum(spark: SparkSession, path: str, older_than: timedelta = timedelta(days=7)) -> list[str]:
    """Delete the folders of replaced commits and of loads that never committed. Those changed
    within ``older_than`` stay, for readers that still use them and for a load that is running."""
    root = path.rstrip("/")
    commits = read_commits(spark, root)
    last = max((k for k, c in enumerate(commits) if "*" in c.replaces), default=0)
    keep = {f"commit={c.name}" for c in live_commits(commits)}
    ledgers = {f"commit={c.name}" for c in commits[last:]}
    before = (datetime.now(timezone.utc) - older_than).timestamp() * 1000
    gone = []
    for folder, wanted in ((root, keep), (f"{root}/{LEDGER}", ledgers)):
        store, place = _store(spark, folder)
        if not store.exists(place):
            continue
        for status in store.listStatus(place):
            name = status.getPath().getName()
            if name.startswith("commit=") and name not in wanted and status.getModificationTime() <= before:
                store.delete(status.getPath(), True)
                gone.append(f"{folder}/{name}")
    return gone
