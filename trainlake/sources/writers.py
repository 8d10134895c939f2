"""Sinks. A table is a folder; nothing is read back to append to it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions.text import user_token
from trainlake.sources.readers import read_csv


#: The rows of a folder are dealt to so many partitions, which AQE merges where they are small.
SHARES = 16


def clustered(df: DataFrame, cols: Sequence[str], sort: Sequence[str] = (), shares: int = 1) -> DataFrame:
    """Bring rows of equal ``cols`` together for a write.

    The rebalance hint lets AQE split a hot group over several tasks and merge small ones,
    so files come out near the advisory size whatever the skew. AQE does not split what one task
    has sent; ``shares`` deals each group to so many partitions by the contents of its rows.
    """
    if shares > 1:
        free = "share"
        while free.lower() in {c.lower() for c in df.columns}:
            free += "_"
        whole = F.xxhash64(*[F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if not has_map(f.dataType)])
        dealt = df.withColumn(free, F.pmod(whole, F.lit(shares))).hint("rebalance", *cols, free)
        return (dealt.sortWithinPartitions(*sort) if sort else dealt).drop(free)
    df = df.hint("rebalance", *cols)
    return df.sortWithinPartitions(*sort) if sort else df


def has_map(kind: T.DataType) -> bool:
    """Maps, and variants that may hold them, have no hash."""
    return any(name in kind.simpleString() for name in ("map<", "variant"))


def ranged(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows dealt and sorted by ranges of ``cols`` for a write.

    The first columns say which rows lie together, such as month and user: a user's rows are
    then in one file of the month, or in neighbouring ones. The last column, such as a time,
    lets a hot user's rows be split over several tasks.
    """
    order = [F.col(f"`{c}`").asc_nulls_first() for c in cols]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_day(df: DataFrame, path: str, day: date) -> str:
    """Replace the partition of one day; other days stay."""
    target = f"{path.rstrip('/')}/year={day.year}/month={day.month:02d}/day={day.day:02d}"
    df.write.mode("overwrite").parquet(target)
    return target


def append_batch(
    df: DataFrame,
    path: str,
    day: date,
    user: str = "user_id",
    by_user: bool = False,
    observe: tuple[Observation, Sequence[Column]] | None = None,
) -> None:
    """Append a raw batch under ``dt=<day>``, sorted by user in each file.

    ``by_user`` puts ``user=<token>/`` above it, for feeds of few users. The token is a folder
    name of up to 12 characters, which several users can share; the rows keep their ``user``.
    ``observe`` collects figures of the written rows while they are written.
    """
    out = df.withColumn("dt", F.lit(day.strftime("%Y%m%d")))
    keys = ["dt"]
    if by_user:
        out = out.withColumn("user", user_token(F.col(user).cast("string")))
        keys = ["user", "dt"]
    out = clustered(out, keys, [*keys, user] if user in df.columns else (), SHARES)
    if observe is not None:
        out = out.observe(observe[0], *observe[1])
    out.write.partitionBy(*keys).mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, day: date) -> str:
    """Dated copy of a table; a second run on one day replaces the first."""
    target = f"{path.rstrip('/')}/snapshot_date={day.strftime('%Y%m%d')}"
    df.write.mode("overwrite").parquet(target)
    return target


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort: Sequence[str] = (),
    ranged_by: Sequence[str] = (),
) -> None:
    """Replace a table. ``path`` must not be a source of ``df``.

    ``ranged_by`` deals the rows by ranges of those columns, see ``ranged``; else they are
    brought together by ``partition_by``, or by ``sort``, and sorted.
    """
    if ranged_by:
        df = ranged(df, ranged_by)
    elif partition_by or sort:
        # By the partition columns alone: a task then writes to one folder, or few, and a
        # large folder is split over many tasks.
        df = clustered(df, partition_by or sort, [*partition_by, *sort])
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows; ``readers.read_appended`` reads a table whose rows have got new columns."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows ``(metric, key, value)`` as JSON lines."""
    df.select("metric", "key", "value").write.mode("overwrite").json(path)


def metric_documents(df: DataFrame) -> DataFrame:
    """One JSON object per metric, for readers that want the document form.

    Meant for metrics with a limited number of keys, such as days or a top list.
    """
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))
    return df.groupBy("metric").agg(F.to_json(pairs).alias("document"))


def write_jsonl(df: DataFrame, path: str, day: date, user: str | None = None) -> None:
    """Append JSON lines under ``dt=`` and, for one user's batch, ``user=``."""
    target = f"{path.rstrip('/')}/dt={day.strftime('%Y%m%d')}"
    if user is not None:
        target += f"/user={user}"
    df.write.mode("append").json(target)


def land_csv(
    spark: SparkSession,
    src: str,
    dst: str,
    day: date | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> None:
    """CSV to Parquet, as a fixed table or as the snapshot of a day. A ``schema`` spares the scan that
    infers one; without line ends in its texts, ``multi_line=False`` spares a shuffle."""
    df = read_csv(spark, src, schema, multi_line)
    if day is None:
        write_table(df, dst)
    else:
        write_snapshot(df, dst, day)


def materialize(df: DataFrame, name: str, kind: str = "view", path: str | None = None) -> DataFrame:
    """Publish a model as a temporary view or as a table, and return it by name."""
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        writer = df.write.mode("overwrite")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    else:
        raise ValueError("kind must be 'view' or 'table'")
    return df.sparkSession.table(name)
