"""Renaming, column selection, filters and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions.text import canonical_email

_FOLD = str.maketrans("çãáé", "caae")


def normalize_columns(df: DataFrame, hyphen: bool = True, fold: bool = False) -> DataFrame:
    """Snake-case column names; ``fold`` also drops the accents of ç ã á é."""
    names = []
    for name in df.columns:
        name = name.strip().lower().replace(" ", "_")
        if hyphen:
            name = name.replace("-", "_")
        names.append(name.translate(_FOLD) if fold else name)
    if len(set(names)) != len(names):
        clashes = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"columns collide after normalising: {clashes}")
    return df.toDF(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def union_aligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both tables by column name; the first one decides each column's type."""
    types = {f.name: f.dataType for f in first.schema.fields}
    casts = {}
    for field in second.schema.fields:
        want = types.get(field.name)
        if want is not None and want != field.dataType:
            casts[field.name] = F.col(f"`{field.name}`").try_cast(want)
    return first.unionByName(second.withColumns(casts), allowMissingColumns=True)


def keep_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[f"`{c}`" for c in cols if c in df.columns])


def order_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Listed columns first, in that order; the others keep their order behind them."""
    known = [c for c in order if c in df.columns]
    return df.select(*[f"`{c}`" for c in known + [c for c in df.columns if c not in known]])


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str], contains: bool = True) -> str | None:
    """First candidate that is a column; else the first column that contains a candidate."""
    exact = next((c for c in candidates if c in df.columns), None)
    if exact is not None or not contains:
        return exact
    wanted = [c.lower() for c in candidates]
    return next((c for c in df.columns if any(w in c.lower() for w in wanted)), None)


def select_expr(df: DataFrame, *exprs: str) -> DataFrame:
    return df.selectExpr(*exprs)


def filter_min(df: DataFrame, name: str, minimum: float, null_as: float = 0) -> DataFrame:
    """Rows at or above the threshold; NULL counts as ``null_as``."""
    value = F.col(name)
    if null_as >= minimum:
        return df.filter(value.isNull() | (value >= minimum))
    return df.filter(value >= minimum)


def filter_since(
    df: DataFrame,
    since: Column | None,
    ts: str = "updated_at",
    fallback: str | None = None,
) -> DataFrame:
    """Rows changed after ``since``. A row without a readable stamp is kept.

    ``fallback`` names the column to read where ``ts`` is NULL or empty. A time-typed
    ``ts`` is compared as it is, so the bound reaches the Parquet scan.
    """
    if since is None:
        return df
    stamp = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.StringType):
        if fallback is not None:
            stamp = F.coalesce(F.nullif(stamp, F.lit("")), F.col(fallback))
        stamp = stamp.try_cast("timestamp")
    elif fallback is not None:
        stamp = F.coalesce(stamp, F.col(fallback))
    return df.filter(stamp.isNull() | (stamp > since))


def for_user(df: DataFrame, user_id: str, key: str = "user_id") -> DataFrame:
    """Rows of one user, compared as text; integer keys are compared as integers so that
    the predicate reaches the Parquet scan."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        text = str(user_id)
        if not text.lstrip("-").isdigit() or str(int(text)) != text:
            return df.filter(F.lit(False))
        return df.filter(F.col(key) == F.lit(int(text)))
    return df.filter(F.col(key).cast("string") == F.lit(str(user_id)))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def lookup(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, null_keys_match: bool = False
) -> DataFrame:
    """Left join that drops ``right_key``; NULL keys meet only when asked to.

    The comparison is null-safe also without such matches. A right side that was grouped by
    its key before keeps that partitioning for a plain comparison, and AQE then cannot
    split a hot key of the left side; for a null-safe one both sides are shuffled anew.
    """
    if not null_keys_match:
        right = right.filter(F.col(right_key).isNotNull())
    on = left[left_key].eqNullSafe(right[right_key])
    return left.join(right, on, "left").drop(right[right_key])


def user_ids_for(
    emails: DataFrame, accounts: DataFrame, default: str | None = None, email: str = "email"
) -> DataFrame:
    """Account id of each e-mail, compared in canonical form; ``default`` where there is none."""
    known = accounts.groupBy(canonical_email(email).alias("_known")).agg(
        F.min(F.col("user_id").cast("string")).alias("user_id")
    )
    asked = emails.withColumn("_asked", canonical_email(email)).drop("user_id")
    out = lookup(asked, known, "_asked", "_known").drop("_asked")
    return out.withColumn("user_id", F.coalesce("user_id", F.lit(default).cast("string")))


def user_id_for(accounts: DataFrame, address: str, default: str) -> DataFrame:
    """One-row table with the account id of ``address``, or ``default``."""
    match = accounts.filter(canonical_email("email") == address.strip().lower())
    found = F.min(F.col("user_id").cast("string"))
    return match.agg(F.coalesce(found, F.lit(default)).alias("user_id"))


def concat_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """One table from many batches, columns by name, absent ones NULL."""
    return reduce(union_aligned, batches)


def key_marks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables with marks ``in_a`` and ``in_b``; NULL is no key.

    One group-by over both tables: copies of a key are combined before the shuffle.
    """
    marks = a.select(key, F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionAll(
        b.select(F.col(key), F.lit(False), F.lit(True))
    )
    both = [F.bool_or(c).alias(c) for c in ("in_a", "in_b")]
    return marks.dropna(subset=[key]).groupBy(key).agg(*both)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct keys in both tables, and distinct keys only in ``b``."""
    marks = key_marks(a, b, key)
    return marks.filter("in_a AND in_b").select(key), marks.filter("NOT in_a").select(key)


def from_rows(spark: SparkSession, rows: Sequence[tuple], cols: str | Sequence[str]) -> DataFrame:
    """Table of literal rows; ``cols`` are names or a DDL schema."""
    return spark.createDataFrame(list(rows), cols if isinstance(cols, str) else list(cols))
