"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkset.tables import Tables
from trainlake.session import apply_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, dates: Sequence[str] = ()):
    """Register ``fn(tables) -> DataFrame`` under its own name, with its SQL.

    The ``dates`` columns are shown as text on both sides: engines hand out dates as
    different kinds of value.
    """

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(apply_defaults(spark), sf_dir))
            return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

        QUERIES[name] = run
        ORACLE[name] = sql
        if dates:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})"
        return fn

    return register


def rounded(expr: str, digits: int) -> str:
    """SQL for a half-up rounding of the shortest decimal form of a double."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"
