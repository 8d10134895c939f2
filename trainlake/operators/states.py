"""Partial states per user that add up: figures of a new load, merged with those of all before.

A state has one row per user and Monday week: rows, sums, counts, time limits, and the training days
of the week as a bitmap of seven bits. Weeks do not overlap, so distinct days are a sum of bit
counts and distinct weeks are a count of rows. States of disjoint rows are merged by adding,
by minimum and maximum, and by OR; the order does not matter, and late rows need no care.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.functions.dates import monday_of
from trainlake.operators.metrics import HISTORY_MEASURES, history_aggs

WEEK, DAYS = "week", "week_days"
# How columns of a state are merged; all others are added.
MERGES = {"first": F.min, "last": F.max, "last_ts": F.max, DAYS: F.bit_or}


def _weekly(df: DataFrame, user: str, ts: str, aggs: Sequence[Column]) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1), F.weekday(F.col(ts)))
    dated = df.filter(F.col(ts).isNotNull())
    return dated.groupBy(user, monday_of(ts).alias(WEEK)).agg(F.bit_or(bit).alias(DAYS), *aggs)


def activity_state(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "date",
    measures: Sequence[str] = ("total_sets", "total_reps", "duration_min"),
) -> DataFrame:
    """The state that ``kpis_from_state`` needs, by one group-by over the rows."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("last_ts")]
    for m in measures:
        aggs += [F.sum(m).alias(m), F.count(m).alias(f"{m}_count")]
    return _weekly(df, user, ts, aggs)


def history_state(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "date",
    sets: str | None = "total_sets",
    reps: str | None = "total_reps",
    weight: str | None = "weight_kg",
    rpe: str | None = "rpe",
) -> DataFrame:
    """The state that ``summary_from_state`` needs, by one group-by over the rows."""
    return _weekly(df, user, ts, history_aggs(df, ts, sets, reps, weight, rpe))


def merge_states(states: DataFrame, keys: Sequence[str] = ("user_id", WEEK), merges: Mapping = MERGES) -> DataFrame:
    """States of disjoint rows as one: a row per key. Also merges the rollups of ``metrics`` by their
    keys, such as user, day and muscle group."""
    figures = [c for c in states.columns if c not in keys]
    return states.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[merges.get(c, F.sum)(f"`{c}`").alias(c) for c in figures])


def kpis_from_state(state: DataFrame, user: str = "user_id") -> DataFrame:
    """``user_kpis`` of all rows whose states ``state`` holds; one row per user and week."""
    measures = [c.removesuffix("_count") for c in state.columns if c.endswith("_count")]
    means = [
        F.round(F.try_divide(F.sum(m).cast("double"), F.sum(f"{m}_count").cast("double")), 1).alias(f"avg_{m}")
        for m in measures
    ]
    days = F.sum(F.bit_count(DAYS)).alias("days")
    return state.groupBy(user).agg(F.sum("n_rows").alias("workouts"), days, F.max("last_ts").cast("date").alias("last_date"), *means)


def summary_from_state(state: DataFrame, user: str = "user_id") -> DataFrame:
    """``training_summary`` of all rows whose states ``state`` holds; one row per user and week."""

    def average(role: str) -> Column:
        return F.round(F.try_divide(F.sum(role).cast("double"), F.sum(f"{role}_n").cast("double")), 2)

    sets, reps, weight, rpe = HISTORY_MEASURES
    # ISO week numbers go up to 53, so those of a user fit into the bits of one long.
    iso = F.bit_or(F.expr(f"shiftleft(1L, weekofyear({WEEK}))"))
    return state.groupBy(user).agg(
        F.sum("n").alias("rows"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.sum(F.bit_count(DAYS)).alias("unique_days"),
        F.bit_count(iso).alias("weeks"),
        F.round(F.sum("n") / F.count(WEEK).cast("double"), 2).alias("avg_sets_per_week_rows"),
        F.round(F.sum(sets).cast("double"), 2).alias("total_sets"),
        F.round(F.sum(reps).cast("double"), 2).alias("total_reps"),
        average(weight).alias("avg_weight"),
        average(rpe).alias("avg_rpe_or_intensity"),
    )


def mark_from_state(state: DataFrame) -> DataFrame:
    """``high_water_mark`` of all rows, from either state."""
    return state.agg(F.max("last_ts" if "last_ts" in state.columns else "last").alias("last_sync"))
