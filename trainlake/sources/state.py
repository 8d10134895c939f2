"""High-water mark of an incremental load, kept as a small JSON table that is only appended to and trimmed."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SCHEMA = "last_sync STRING, written_at STRING"


def _store(spark: SparkSession, path: str):
    """File system and path object of a place, also where it does not exist."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_watermark(spark: SparkSession, path: str) -> datetime | None:
    """Last stored mark as UTC time; a missing or unreadable state means a full load."""
    store, place = _store(spark, path)
    if not store.exists(place):
        return None
    state = spark.read.schema(_SCHEMA).option("multiLine", True).json(path)
    mark = F.col("last_sync").try_cast("timestamp")
    newest = F.max_by(mark, F.coalesce("written_at", F.lit("")))
    micros = state.filter(mark.isNotNull()).agg(F.unix_micros(newest)).first()[0]
    if micros is None:
        return None
    seconds, rest = divmod(micros, 1_000_000)
    return datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=rest)


def write_watermark(spark: SparkSession, path: str, mark: datetime) -> None:
    """Add a mark; call it only after the data write. The old mark stays until the new
    one is complete, so a crash in between never loses the state."""
    if mark.tzinfo is None:
        mark = mark.replace(tzinfo=timezone.utc)
    written = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    row = spark.createDataFrame([(mark.isoformat(), written)], _SCHEMA)
    store, place = _store(spark, path)
    before = [s.getPath() for s in store.listStatus(place) if s.isFile()] if store.exists(place) else []
    row.coalesce(1).write.mode("append").json(path)
    # The new mark is complete; of the older ones the last two stay for a look back.
    marks = sorted((p for p in before if p.getName().startswith("part-")), key=lambda p: store.getFileStatus(p).getModificationTime())
    for old in marks[:-2]:
        store.delete(old, False)
