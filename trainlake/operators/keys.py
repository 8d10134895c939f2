"""De-duplication and key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions.dates import parse_timestamp
from trainlake.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def time_order(df: DataFrame, ts: str) -> Column:
    """A time column to order by; text is parsed, so that offsets and spellings count as times.
    Unreadable text has no time."""
    kind = df.schema[ts].dataType
    return parse_timestamp(F.col(f"`{ts}`")) if isinstance(kind, T.StringType) else F.col(f"`{ts}`")


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str | None = None
) -> DataFrame:
    """First ``n`` rows of each key in an explicit order.

    Spark keeps at most ``n`` rows per key and map task before the shuffle, so a hot key
    never reaches one task whole.
    """
    rank = name or "_rank"
    # Without an order all rows of a key are equally good.
    window = Window.partitionBy(*keys).orderBy(*(order or keys))
    out = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return out if name else out.drop(rank)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_n_per_key(df, keys, order, 1)


def latest_per_key(
    df: DataFrame,
    key: str,
    ts: str | None = None,
    nulls: str = "lose",
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Newest row of each key. ``nulls="win"`` prefers a row without a time. A text ``ts`` is
    compared as the time it says.

    Ties go to the greatest ``tie_break`` columns, by default all sortable ones, so that
    the result does not depend on the order of the rows.
    """
    if nulls not in ("win", "lose"):
        raise ValueError("nulls must be 'win' or 'lose'")
    order = []
    if ts is not None and ts in df.columns:
        time = time_order(df, ts)
        order.append(time.desc_nulls_first() if nulls == "win" else time.desc_nulls_last())
    if tie_break is None:
        tie_break = [f.name for f in df.schema.fields if f.name not in (key, ts) and "map" not in f.dataType.simpleString()]
    order += [F.desc_nulls_last(f"`{c}`") for c in tie_break]
    return first_per_key(df, [key], order)


def surrogate_key(
    df: DataFrame, name: str, order: Sequence[str], start: int = 1, distinct: bool = True
) -> DataFrame:
    """Dense key ``start..`` in the order of the listed columns.

    The rows are range-partitioned and sorted, and kept by a reliable checkpoint, so that
    both uses below see the same partitions even after an executor is lost. Then a row's
    key is its place in the partition plus the size of the partitions before it. The only
    window runs over one row per partition.

    ``distinct=False`` is for tables that may hold many copies of a row: the rows are
    checkpointed first and their fixed position becomes the last sort column, so that a
    group of copies spreads over several ranges.
    """
    cols = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    names = df.columns
    if not distinct:
        df = cut_lineage(df).withColumn("_position", F.monotonically_increasing_id())
        cols.append(F.col("_position").asc())
    placed = cut_lineage(df.repartitionByRange(*cols).sortWithinPartitions(*cols))
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.select(
        "*",
        F.shiftright("_id", _ROW_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_part").alias("_key_part"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    keyed = placed.join(F.broadcast(offsets), placed["_part"] == offsets["_key_part"])
    key = (F.col("_offset") + F.col("_row") + F.lit(start)).cast("long").alias(name)
    return keyed.select(key, *[f"`{c}`" for c in names])


def ensure_id(df: DataFrame, name: str, order: Sequence[str], alt: str | None = None) -> DataFrame:
    """Give the table an id: its own, else the renamed ``alt``, else the position as text."""
    if name in df.columns:
        return df
    if alt is not None and alt in df.columns:
        return df.withColumnRenamed(alt, name)
    keyed = surrogate_key(df, name, order, start=0, distinct=False)
    return keyed.withColumn(name, F.col(name).cast("string"))
