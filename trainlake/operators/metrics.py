"""Aggregates of the gold layer, computed for all users at once.

Each operator starts with a plain group-by, so rows are combined before the shuffle and
a user with a third of all rows sends only a few partial groups. Windows run over
grouped rows only, never over the sets themselves. Keys that are NULL form no group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlake.functions.dates import month_of, monday_of, sunday_week
from trainlake.functions.values import mean
from trainlake.operators.keys import first_n_per_key
from trainlake.operators.shape import resolve_column

# Columns that can stand for intensity, best first.
INTENSITY_COLUMNS = ("avg_rpe", "intensity", "avg_load", "load_kg")


def _total(col: Column | str) -> Column:
    """Sum that is 0 when there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0))


def _rows(rows: str | None) -> Column:
    """Row count, or the sum of the counts a pre-aggregated table carries."""
    return F.count(F.lit(1)) if rows is None else F.sum(rows)


# --- daily figures of the whole table -------------------------------------------------


def volume_per_day(
    df: DataFrame, ts: str = "start_time", weight: str = "weight_kg", reps: str = "reps"
) -> DataFrame:
    day = F.col(ts).cast("date").alias("date")
    volume = _total(F.col(weight) * F.col(reps)).alias("volume")
    return df.filter(F.col(ts).isNotNull()).groupBy(day).agg(volume)


def rows_per_day(df: DataFrame, ts: str = "start_time") -> DataFrame:
    day = F.col(ts).cast("date").alias("date")
    return df.filter(F.col(ts).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("n"))


def top_exercises(
    df: DataFrame, exercise: str = "exercise_title", n: int = 50, rows: str | None = None
) -> DataFrame:
    """Most frequent exercises; equal counts go by name."""
    counts = df.filter(F.col(exercise).isNotNull()).groupBy(exercise).agg(_rows(rows).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(exercise)).limit(n)


# --- dashboard ------------------------------------------------------------------------


def activity_rollup(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "date",
    keys: Sequence[str] = ("muscle_group",),
    measures: Sequence[str] = ("total_sets", "total_reps", "duration_min"),
) -> DataFrame:
    """Rows, sums and counts per user, day and the listed keys.

    One pass over the workouts; the dashboard tables are built from it. ``<m>`` is the sum
    of a measure and ``<m>_count`` the number of its values. Columns that the table lacks are
    left out; without a time there is no ``day`` and every row counts.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        if m in df.columns:
            aggs += [F.sum(m).alias(m), F.count(m).alias(f"{m}_count")]
    keys = [k for k in keys if k in df.columns]
    if ts not in df.columns:
        return df.groupBy(user, *keys).agg(*aggs)
    day = F.col(ts).cast("date").alias("day")
    return df.filter(F.col(ts).isNotNull()).groupBy(user, day, *keys).agg(F.max(ts).alias("last_ts"), *aggs)


def kpis_from_rollup(rollup: DataFrame, user: str = "user_id") -> DataFrame:
    """KPI row per user from ``activity_rollup``; means have one decimal. Without days there is
    no number of days and no last date."""
    measures = [c.removesuffix("_count") for c in rollup.columns if c.endswith("_count")]
    sums = [F.sum(m).alias(m) for m in measures] + [F.sum(f"{m}_count").alias(f"{m}_count") for m in measures]
    dated = "day" in rollup.columns
    days = rollup if not dated else rollup.groupBy(user, "day").agg(
        F.sum("n_rows").alias("n_rows"), F.max("last_ts").alias("last_ts"), *sums
    )
    means = [
        F.round(
            F.try_divide(F.sum(m).cast("double"), F.sum(f"{m}_count").cast("double")), 1
        ).alias(f"avg_{m}")
        for m in measures
    ]
    times = [F.count("day").alias("days"), F.max("last_ts").cast("date").alias("last_date")] if dated else []
    return days.groupBy(user).agg(F.sum("n_rows").alias("workouts"), *times, *means)


def user_kpis(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "date",
    measures: Sequence[str] = ("total_sets", "total_reps", "duration_min"),
) -> DataFrame:
    """Workouts, training days, last day and means per user.

    Grouping by day first makes the distinct days a plain count.
    """
    return kpis_from_rollup(activity_rollup(df, user, ts, keys=(), measures=measures), user)


def weekly_frequency(
    df: DataFrame, user: str = "user_id", ts: str = "date", rows: str | None = None
) -> DataFrame:
    """Workouts per user and Sunday week."""
    week = sunday_week(ts).alias("year_week")
    return df.filter(F.col(ts).isNotNull()).groupBy(user, week).agg(_rows(rows).alias("workouts"))


def daily_sets(
    df: DataFrame, user: str = "user_id", ts: str = "date", sets: str = "total_sets"
) -> DataFrame:
    day = F.col(ts).cast("date").alias("day")
    return df.filter(F.col(ts).isNotNull()).groupBy(user, day).agg(_total(sets).alias("daily_sets"))


def rolling_mean(
    daily: DataFrame,
    n: int = 7,
    user: str = "user_id",
    day: str = "day",
    value: str = "daily_sets",
    name: str = "rolling_7d",
) -> DataFrame:
    """Mean over the last ``n`` rows (not days) of each user, fewer at the start.

    Takes daily rows: a user has one per training day, whatever the number of sets.
    """
    window = Window.partitionBy(user).orderBy(day).rowsBetween(1 - n, 0)
    return daily.withColumn(name, F.try_divide(F.sum(value).over(window).cast("double"), F.count(value).over(window)))


def muscle_share(
    df: DataFrame,
    user: str = "user_id",
    muscle: str = "muscle_group",
    sets: str = "total_sets",
) -> DataFrame:
    """Sets per muscle group and their share in the user's total, in percent."""
    volume = df.filter(F.col(muscle).isNotNull()).groupBy(user, muscle).agg(_total(sets).alias("total_sets"))
    total = F.sum("total_sets").over(Window.partitionBy(user))
    share = F.try_divide(F.lit(100.0) * F.col("total_sets").cast("double"), total.cast("double"))
    return volume.withColumn("percent", share)


def exercise_ranking(
    df: DataFrame,
    n: int = 10,
    user: str = "user_id",
    exercise: str = "exercise_name",
    sets: str = "total_sets",
) -> DataFrame:
    """The ``n`` exercises with the most sets per user; equal sums go by name."""
    volume = df.filter(F.col(exercise).isNotNull()).groupBy(user, exercise).agg(_total(sets).alias("total_sets"))
    return first_n_per_key(volume, [user], [F.desc("total_sets"), F.asc(exercise)], n, "position")


def dow_muscle_matrix(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "date",
    muscle: str = "muscle_group",
    sets: str = "total_sets",
) -> DataFrame:
    """Sets per day of week and muscle group; ``dow_index`` 0 is Monday."""
    return (
        df.filter(F.col(ts).isNotNull() & F.col(muscle).isNotNull())
        .groupBy(
            user,
            F.weekday(F.col(ts)).alias("dow_index"),
            F.date_format(F.col(ts), "EEEE").alias("dow"),
            F.col(muscle),
        )
        .agg(_total(sets).alias("total_sets"))
    )


_SLACK = 1e-9  # room for binary rounding when a value lies on a bin limit


def _scaled(number: Column, exponent: Column) -> Column:
    """``number * 10 ** exponent`` without the error of a negative power of ten."""
    up = F.pow(F.lit(10.0), F.greatest(exponent, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-exponent, F.lit(0)))
    return number * up / down


def _bin_width(low: Column, high: Column, maxbins: int) -> tuple[Column, Column]:
    """Width ``m * 10 ** e`` as (m, e): the smallest with m 1, 2 or 5 and at most ``maxbins`` bins."""
    span = F.coalesce(
        F.nullif(high - low, F.lit(0.0)), F.nullif(F.abs(low), F.lit(0.0)), F.lit(1.0)
    )
    exponent = F.ceil(F.log10(span / F.lit(float(maxbins))) - _SLACK).cast("int") - 1
    bins = _scaled(span, -exponent)
    fits = maxbins * (1 + _SLACK)
    return F.when(bins / 2 <= fits, 2).when(bins / 5 <= fits, 5).otherwise(10), exponent


def intensity_histogram(
    df: DataFrame, col: str | None = None, maxbins: int = 20, user: str = "user_id"
) -> DataFrame:
    """Counts per user and bin; bins have a round width and start at a multiple of it.

    The limits of a user are found first, combined on the map side. The rows get them by a join,
    which needs no shuffle of the rows while the users are few, and are counted per user and
    bin, again combined on the map side.
    """
    col = col or resolve_column(df, INTENSITY_COLUMNS, contains=False)
    if col is None:
        raise ValueError(f"no intensity column among {INTENSITY_COLUMNS}")
    values = df.filter(F.col(col).isNotNull()).select(user, F.col(col).cast("double").alias("value"))
    limits = values.groupBy(user).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    m, exponent = _bin_width(F.col("_low"), F.col("_high"), maxbins)
    limits = limits.select(F.col(user).alias("_user"), "_low", "_high", m.alias("_m"), exponent.alias("_e"))

    def place(value: str) -> Column:
        """Position of a value in units of the bin width."""
        return _scaled(F.col(value), -F.col("_e")) / F.col("_m")

    # Null-safe, see ``lookup``: a user with very many values is split for the join.
    binned = values.join(limits, values[user].eqNullSafe(limits["_user"]))
    # The top value belongs to the last bin, also where it equals the upper limit.
    last = F.greatest(F.ceil(place("_high") - _SLACK) - 1, F.floor(place("_low") + _SLACK))
    index = F.least(F.floor(place("value") + _SLACK), last)
    binned = binned.select(user, "_m", "_e", index.alias("_bin"))
    return (
        binned.groupBy(user, "_bin", "_m", "_e")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            user,
            _scaled(F.col("_bin") * F.col("_m"), F.col("_e")).alias("bin_start"),
            _scaled((F.col("_bin") + 1) * F.col("_m"), F.col("_e")).alias("bin_end"),
            "n",
        )
    )


def value_counts(
    df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """Rows per value (and per ``by`` columns); NULL is not counted."""
    value = F.col(col).alias(name or col)
    return df.filter(F.col(col).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def duration_volume(
    df: DataFrame, ts: str = "date", duration: str = "duration_min", sets: str = "total_sets"
) -> DataFrame:
    cols = [ts] if ts in df.columns else []
    keys = ["user_id"] if "user_id" in df.columns else []
    return df.select(*keys, *cols, duration, sets)


def last_rows(
    df: DataFrame,
    n: int = 10,
    user: str = "user_id",
    ts: str = "date",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The last ``n`` rows of each user; ``position`` 1 is the oldest of them.

    ``tie_break`` orders rows of one time, the last of them winning.
    """
    dated = df.filter(F.col(ts).isNotNull())
    order = [F.desc(ts), *[F.desc_nulls_last(c) for c in tie_break]]
    kept = first_n_per_key(dated, [user], order, n, "_back")
    back = Window.partitionBy(user)
    position = (F.max("_back").over(back) - F.col("_back") + 1).alias("position")
    text = F.date_format(F.col(ts), "yyyy-MM-dd").alias(ts)
    return kept.select(position, *[text if c == ts else F.col(f"`{c}`") for c in df.columns])


def detail_table(
    df: DataFrame, ts: str = "date", drop: Sequence[str] = ("workout_id",), user: str = "user_id"
) -> DataFrame:
    """All rows without the technical columns, those of a user together and newest first.

    A page shows one user, so rows are dealt by ranges of the user, never sorted as one list.
    The time and the dropped columns end the range: they split a hot user over several tasks.
    """
    keep = [c for c in df.columns if c not in drop]
    order = [F.asc_nulls_first(user)] if user in df.columns else []
    order += [F.desc(ts)] if ts in df.columns else []
    order += [F.asc_nulls_first(c) for c in drop if c in df.columns]
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return df.select(*[f"`{c}`" for c in keep])


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


# --- summaries ------------------------------------------------------------------------


HISTORY_MEASURES = ("sets", "reps", "weight", "rpe")


def history_rollup(
    df: DataFrame,
    user: str = "user_id",
    ts: str | None = "date",
    keys: Sequence[str] = (),
    sets: str | None = "total_sets",
    reps: str | None = "total_reps",
    weight: str | None = "weight_kg",
    rpe: str | None = "rpe",
) -> DataFrame:
    """Rows, time limits, sums and counts per user, day and the listed keys; without a time
    (``ts`` None) rows, sums and counts per user and keys."""
    aggs = history_aggs(df, ts, sets, reps, weight, rpe)
    if ts is None:
        return df.groupBy(user, *keys).agg(*aggs)
    day = F.col(ts).cast("date").alias("day")
    return df.filter(F.col(ts).isNotNull()).groupBy(user, day, *keys).agg(*aggs)


def history_aggs(df: DataFrame, ts: str | None, *measures: str | None) -> list[Column]:
    """Rows, time limits, and sum and count of the measures in the order of ``HISTORY_MEASURES``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if ts is not None:
        aggs += [F.min(ts).alias("first"), F.max(ts).alias("last")]
    for role, name in zip(HISTORY_MEASURES, measures, strict=True):
        value = F.lit(None).cast("double")
        if name is not None and name in df.columns:
            value = F.col(name)
            if dict(df.dtypes)[name] == "string":
                value = value.try_cast("double")
        aggs += [F.sum(value).alias(role), F.count(value).alias(f"{role}_n")]
    return aggs


def summary_from_rollup(rollup: DataFrame, user: str = "user_id") -> DataFrame:
    """``training_summary`` from ``history_rollup``: first to weeks, then to users."""
    measures = [c for role in HISTORY_MEASURES for c in (role, f"{role}_n")]

    def total(role: str) -> Column:
        return F.round(F.sum(role).cast("double"), 2)

    def average(role: str) -> Column:
        count = F.sum(f"{role}_n").cast("double")
        return F.round(F.try_divide(F.sum(role).cast("double"), count), 2)

    figures = [
        total("sets").alias("total_sets"),
        total("reps").alias("total_reps"),
        average("weight").alias("avg_weight"),
        average("rpe").alias("avg_rpe_or_intensity"),
    ]
    if "day" not in rollup.columns:
        return rollup.groupBy(user).agg(F.sum("n").alias("rows"), *figures)
    days = rollup
    if set(rollup.columns) - {user, "day", "n", "first", "last", *measures}:
        days = rollup.groupBy(user, "day").agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            *[F.sum(c).alias(c) for c in ("n", *measures)],
        )
    weeks = days.groupBy(user, monday_of("day").alias("_week")).agg(
        # ISO week numbers go up to 53, so those of a user fit into the bits of one long.
        F.bit_or(F.expr("shiftleft(1L, weekofyear(day))")).alias("_iso"),
        F.count("day").alias("_days"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in ("n", *measures)],
    )

    return weeks.groupBy(user).agg(
        F.sum("n").alias("rows"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.sum("_days").alias("unique_days"),
        F.bit_count(F.bit_or("_iso")).alias("weeks"),
        F.round(F.sum("n") / F.count("_week").cast("double"), 2).alias("avg_sets_per_week_rows"),
        *figures,
    )


def training_summary(
    df: DataFrame,
    user: str = "user_id",
    ts: str | None = "date",
    sets: str | None = "total_sets",
    reps: str | None = "total_reps",
    weight: str | None = "weight_kg",
    rpe: str | None = "rpe",
) -> DataFrame:
    """History figures per user.

    ``weeks`` counts ISO week numbers, so week 1 of two years is one; the weekly mean uses
    real Monday weeks. A sum or mean without any numeric value is NULL. Without a time column
    (``ts`` None) the figures that need one are left out and every row counts.
    """
    rollup = history_rollup(df, user, ts, (), sets, reps, weight, rpe)
    return summary_from_rollup(rollup, user)


def top_categories(
    df: DataFrame,
    col: str,
    n: int = 8,
    user: str = "user_id",
    null_as_text: bool = False,
    rows: str | None = None,
) -> DataFrame:
    """The ``n`` most frequent values per user with counts; equal counts go by value.

    ``rows`` names the column of row counts when the table is already grouped.
    """
    value = F.col(col).cast("string")
    if null_as_text:
        value = F.coalesce(value, F.lit("None"))
    weight = F.lit(1) if rows is None else F.col(rows)
    named = df.select(F.col(user), value.alias("value"), weight.alias("n")).dropna(subset=["value"])
    counts = named.groupBy(user, "value").agg(F.sum("n").cast("long").alias("n"))
    return first_n_per_key(counts, [user], [F.desc("n"), F.asc("value")], n, "position")


def table_counts(df: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """One row: all rows, and the distinct non-NULL values of each listed column.

    A row becomes one narrow row ``(column, value)`` per listed column; these are combined on the
    map side, moved once by hash, and counted. Values are compared whole, as text.
    """
    if not cols:
        return df.agg(F.count(F.lit(1)).alias("n_rows"))
    pairs = F.array(*[F.struct(F.lit(k).alias("place"), _as_text(df, c).alias("value")) for k, c in enumerate(cols)])
    values = df.select(F.inline(pairs)).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
    figures = values.groupBy("place").agg(F.sum("n").alias("n"), F.count("value").alias("n_values"))
    distinct = [
        F.coalesce(F.max(F.when(F.col("place") == k, F.col("n_values"))), F.lit(0)).alias(f"distinct_{c}")
        for k, c in enumerate(cols)
    ]
    return figures.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_rows"), *distinct)


def _as_text(df: DataFrame, name: str) -> Column:
    """A text that two values share only if they are equal."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (value + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(value.isNotNull(), F.to_json(F.struct(value)))
    return value.cast("string")


def high_water_mark(
    df: DataFrame, ts: str = "updated_at", fallback: str | None = None, missing: Column | None = None
) -> DataFrame:
    """Greatest change time; a row without one counts with ``fallback``, then ``missing``."""
    stamp = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        stamp = F.nullif(stamp, F.lit(""))
        if fallback is not None:
            stamp = F.coalesce(stamp, F.col(fallback))
        stamp = stamp.try_cast("timestamp")
    elif fallback is not None:
        stamp = F.coalesce(stamp, F.col(fallback))
    if missing is not None:
        stamp = F.coalesce(stamp, missing)
    return df.agg(F.max(stamp).alias("last_sync"))


def monthly_summary(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "date",
    sets: str = "total_sets",
    reps: str = "total_reps",
) -> DataFrame:
    """Workouts, training days, sets and repetitions per user and month."""
    rollup = activity_rollup(df, user, ts, keys=(), measures=(sets, reps))
    return rollup.groupBy(user, month_of("day").alias("month")).agg(
        F.sum("n_rows").alias("workouts"),
        F.count("day").alias("days"),
        _total(sets).alias("total_sets"),
        _total(reps).alias("total_reps"),
    )


def vs_global_mean(df: DataFrame, col: str = "total_sets", user: str = "user_id") -> DataFrame:
    """Mean of each user next to the mean of all rows. The global side is one row."""
    users = df.groupBy(user).agg(
        F.sum(col).alias("_sum"), F.count(col).alias("_n"), mean(col).alias("user_mean")
    )
    overall = users.agg(
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_n").cast("double")).alias("global_mean")
    )
    out = users.select(user, "user_mean").withColumn("global_mean", overall.scalar())
    return out.withColumn("difference", F.col("user_mean") - F.col("global_mean"))


def progression(
    df: DataFrame,
    user: str = "user_id",
    exercise: str = "exercise_title",
    ts: str = "start_time",
    weight: str = "weight_kg",
    reps: str = "reps",
) -> DataFrame:
    """Load and volume per user, exercise and day, with the change since the day before."""
    days = (
        df.filter(F.col(ts).isNotNull() & F.col(exercise).isNotNull())
        .groupBy(user, exercise, F.col(ts).cast("date").alias("day"))
        .agg(
            F.max(weight).alias("max_weight"),
            _total(F.col(weight) * F.col(reps)).alias("volume"),
        )
    )
    window = Window.partitionBy(user, exercise).orderBy("day")
    return days.withColumns(
        {
            "weight_change": F.col("max_weight") - F.lag("max_weight").over(window),
            "volume_change": F.col("volume") - F.lag("volume").over(window),
        }
    )
