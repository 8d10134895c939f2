"""Zone maps: which values each file of a table holds, so that a read opens few files.

``write_zones`` notes the least and the greatest value of some columns, and the rows, of each file, in
a small table below ``_zones``. A reader asks it for the files that can hold a value, and opens
those alone: neither footers nor data of the others are touched. The map belongs to one state of
the table: if the files are others than those that it knows, the reader does without it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.sources.commits import _store, file_names, listed_files

ZONES = "_zones"


def write_zones(spark: SparkSession, path: str, columns: Sequence[str]) -> None:
    """Make the zone map of a table that has just been written, from these columns of it alone."""
    root = path.rstrip("/")
    df = spark.read.parquet(root)
    file = F.col("_metadata.file_path").alias("file")
    limits = [f(F.col(f"`{c}`")).alias(f"{kind}_{c}") for c in columns for kind, f in (("min", F.min), ("max", F.max))]
    # Spark groups texts' limits by hash, not by sorting all rows with their paths, if an aggregate of
    # lists is among them.
    by_hash = F.collect_set(F.lit(True)).alias("by_hash")
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in columns]
    zones = df.select(file, *[F.col(f"`{c}`") for c in columns]).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *limits, *nulls, by_hash)
    # Files come in the order of their first column, so a reader of the map skips most of it, too.
    zones.filter(F.size("by_hash") > 0).drop("by_hash").orderBy(f"min_{columns[0]}", "file").write.mode("overwrite").parquet(f"{root}/{ZONES}")


def read_zones(spark: SparkSession, path: str) -> DataFrame | None:
    """The zone map; None where there is none, or where the table's files are not those it knows."""
    root = path.rstrip("/")
    store, place = _store(spark, f"{root}/{ZONES}")
    if not store.exists(place):
        return None
    zones = spark.read.parquet(f"{root}/{ZONES}")
    files = listed_files(spark, root).select("file")
    return zones if files.exceptAll(zones.select("file")).isEmpty() else None


def files_where(spark: SparkSession, path: str, column: str, low, high=None) -> list[str] | None:
    """The files that can hold rows whose ``column`` is ``low``, or from ``low`` to ``high``; None if no
    map of the column is there that fits the table."""
    root = path.rstrip("/")
    zones = read_zones(spark, root)
    if zones is None or f"min_{column}" not in zones.columns:
        return None
    kind = zones.schema[f"min_{column}"].dataType
    least, most = F.lit(low).cast(kind), F.lit(low if high is None else high).cast(kind)
    met = zones.filter((F.col(f"min_{column}") <= most) & (F.col(f"max_{column}") >= least))
    return file_names(listed_files(spark, root).join(met.select("file"), "file", "left_semi"))
