"""Aggregates, rankings and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query, rounded
from checkset.tables import Tables, with_views
from trainlake.operators import metrics as mt


@query(
    with_views(
        "sets",
        """SELECT CAST(start_time AS DATE) AS date, CAST(sum(weight_kg * reps) AS DOUBLE) AS volume
        FROM sets GROUP BY 1""",
    ),
    dates=["date"],
)
def volume_per_day(t: Tables) -> DataFrame:
    return mt.volume_per_day(t.sets())


@query(with_views("sets", "SELECT CAST(start_time AS DATE) AS date, count(*) AS n FROM sets GROUP BY 1"), dates=["date"])
def rows_per_day(t: Tables) -> DataFrame:
    return mt.rows_per_day(t.sets())


@query(
    with_views(
        "sets",
        """SELECT exercise_title, count(*) AS n FROM sets GROUP BY 1
        ORDER BY n DESC, exercise_title LIMIT 50""",
    )
)
def top_exercises(t: Tables) -> DataFrame:
    return mt.top_exercises(t.sets())


KPI_SQL = f"""SELECT user_id, count(*) AS workouts, count(DISTINCT CAST(date AS DATE)) AS days,
      CAST(max(date) AS DATE) AS last_date,
      {rounded('CAST(sum(total_sets) AS DOUBLE) / count(total_sets)', 1)} AS avg_total_sets,
      {rounded('CAST(sum(total_reps) AS DOUBLE) / count(total_reps)', 1)} AS avg_total_reps,
      {rounded('CAST(sum(duration_min) AS DOUBLE) / count(duration_min)', 1)} AS avg_duration_min
    FROM workouts WHERE date IS NOT NULL GROUP BY user_id"""


@query(with_views("workouts", KPI_SQL), dates=["last_date"])
def user_kpis(t: Tables) -> DataFrame:
    return mt.user_kpis(t.workouts())


@query(
    with_views(
        "workouts",
        """SELECT user_id, strftime(date, '%Y-%U') AS year_week, count(*) AS workouts
        FROM workouts WHERE date IS NOT NULL GROUP BY 1, 2""",
    )
)
def weekly_frequency(t: Tables) -> DataFrame:
    return mt.weekly_frequency(t.workouts())


_DAILY = """SELECT user_id, CAST(date AS DATE) AS day, coalesce(sum(total_sets), 0) AS daily_sets
    FROM workouts WHERE date IS NOT NULL GROUP BY 1, 2"""


@query(
    with_views(
        "workouts", f"SELECT user_id, day, CAST(daily_sets AS BIGINT) AS daily_sets FROM ({_DAILY})"
    ),
    dates=["day"],
)
def daily_sets(t: Tables) -> DataFrame:
    return mt.daily_sets(t.workouts())


_LAST_7 = "OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(
    with_views(
        "workouts",
        f"""SELECT user_id, day, CAST(daily_sets AS BIGINT) AS daily_sets,
          CAST(sum(daily_sets) {_LAST_7} AS DOUBLE) / count(*) {_LAST_7} AS rolling_7d
        FROM ({_DAILY})""",
    ),
    dates=["day"],
)
def rolling_mean(t: Tables) -> DataFrame:
    return mt.rolling_mean(mt.daily_sets(t.workouts()))


_SHARE = """SELECT user_id, muscle_group, coalesce(sum(total_sets), 0) AS v
    FROM workouts WHERE muscle_group IS NOT NULL GROUP BY 1, 2"""


@query(
    with_views(
        "workouts",
        f"""SELECT user_id, muscle_group, CAST(v AS BIGINT) AS total_sets,
          100.0 * CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY user_id) AS DOUBLE) AS percent
        FROM ({_SHARE})""",
    )
)
def muscle_share(t: Tables) -> DataFrame:
    return mt.muscle_share(t.workouts())


@query(
    with_views(
        "sets",
        """SELECT user_id, exercise_title, CAST(v AS DOUBLE) AS total_sets,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY v DESC, exercise_title) AS INTEGER) AS position
        FROM (SELECT user_id, exercise_title, sum(reps) AS v FROM sets GROUP BY 1, 2)
        QUALIFY position <= 10""",
    )
)
def exercise_ranking(t: Tables) -> DataFrame:
    ranking = mt.exercise_ranking(t.sets(), exercise="exercise_title", sets="reps")
    return ranking


@query(
    with_views(
        "workouts",
        """SELECT user_id, CAST(isodow(date) - 1 AS INTEGER) AS dow_index, dayname(date) AS dow,
          muscle_group, CAST(coalesce(sum(total_sets), 0) AS BIGINT) AS total_sets
        FROM workouts WHERE date IS NOT NULL AND muscle_group IS NOT NULL GROUP BY 1, 2, 3, 4""",
    )
)
def dow_muscle_matrix(t: Tables) -> DataFrame:
    return mt.dow_muscle_matrix(t.workouts())


@query(
    with_views(
        "sets",
        """, limits AS (SELECT user_id, min(reps) AS lo, max(reps) AS hi FROM sets GROUP BY 1),
        spans AS (SELECT *, CASE WHEN hi > lo THEN hi - lo WHEN lo <> 0 THEN abs(lo) ELSE 1 END AS span
          FROM limits),
        steps AS (SELECT *, (SELECT min(m * pow(10, e)) FROM (VALUES (1), (2), (5)) a(m), range(-3, 6) b(e)
          WHERE span / (m * pow(10, e)) <= 20.0000001) AS step FROM spans),
        bins AS (SELECT user_id, step, least(floor(reps / step + 1e-9),
            greatest(ceil(hi / step - 1e-9) - 1, floor(lo / step + 1e-9))) AS bin
          FROM sets JOIN steps USING (user_id))
        SELECT user_id, CAST(CAST(round(bin * step, 3) AS DECIMAL(18,3)) AS DOUBLE) AS bin_start,
          CAST(CAST(round((bin + 1) * step, 3) AS DECIMAL(18,3)) AS DOUBLE) AS bin_end, count(*) AS n
        FROM bins GROUP BY ALL""",
    )
)
def intensity_histogram(t: Tables) -> DataFrame:
    return mt.intensity_histogram(t.sets(), "reps")


@query(
    with_views(
        "sets",
        "SELECT user_id, rpe, count(*) AS n FROM sets WHERE rpe IS NOT NULL GROUP BY 1, 2",
    )
)
def value_counts(t: Tables) -> DataFrame:
    return mt.value_counts(t.sets(), "rpe", ["user_id"])


_WEEKS = "count(DISTINCT date_trunc('week', date))"
SUMMARY_SQL = f"""SELECT user_id, count(*) AS rows, min(date) AS first_date, max(date) AS last_date,
      count(DISTINCT CAST(date AS DATE)) AS unique_days, count(DISTINCT weekofyear(date)) AS weeks,
      {rounded(f'CAST(count(*) AS DOUBLE) / {_WEEKS}', 2)} AS avg_sets_per_week_rows,
      CAST(sum(total_sets) AS DOUBLE) AS total_sets, CAST(sum(total_reps) AS DOUBLE) AS total_reps,
      {rounded('CAST(sum(weight_kg) AS DOUBLE) / count(weight_kg)', 2)} AS avg_weight,
      {rounded('CAST(sum(rpe) AS DOUBLE) / count(rpe)', 2)} AS avg_rpe_or_intensity
    FROM workouts WHERE date IS NOT NULL GROUP BY user_id"""


@query(with_views("workouts", SUMMARY_SQL))
def training_summary(t: Tables) -> DataFrame:
    return mt.training_summary(t.workouts())


def top_sql(col: str, dated: bool = True) -> str:
    return f"""SELECT user_id, {col} AS value, count(*) AS n, CAST(row_number() OVER
      (PARTITION BY user_id ORDER BY count(*) DESC, {col}) AS INTEGER) AS position
    FROM workouts WHERE {col} IS NOT NULL {"AND date IS NOT NULL" if dated else ""} GROUP BY user_id, {col}
    QUALIFY position <= 8"""


@query(with_views("workouts", top_sql("exercise_name")))
def top_categories(t: Tables) -> DataFrame:
    return mt.top_categories(t.workouts().filter("date IS NOT NULL"), "exercise_name")


@query(
    """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS distinct_l_orderkey,
      count(DISTINCT l_partkey) AS distinct_l_partkey FROM lineitem"""
)
def table_counts(t: Tables) -> DataFrame:
    return mt.table_counts(t.lineitem, ["l_orderkey", "l_partkey"])


@query("SELECT max(ts) AS last_sync FROM events")
def high_water_mark(t: Tables) -> DataFrame:
    return mt.high_water_mark(t.events, "ts")


@query(
    """SELECT max(CASE WHEN event_type = 'view' THEN NULL ELSE date_trunc('second', ts) END)
      AS last_sync FROM events"""
)
def high_water_mark_text(t: Tables) -> DataFrame:
    kind, text = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = t.events.select(
        F.when(kind == "click", F.lit("")).when(kind == "view", F.lit("bad")).otherwise(text).alias("updated_at"),
        text.alias("created_at"),
    )
    mark = mt.high_water_mark(raw, fallback="created_at")
    return mark.select(F.col("last_sync").cast("timestamp_ntz").alias("last_sync"))


@query(
    with_views(
        "workouts",
        """SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS workouts,
          count(DISTINCT CAST(date AS DATE)) AS days, CAST(coalesce(sum(total_sets), 0) AS BIGINT) AS total_sets,
          CAST(coalesce(sum(total_reps), 0) AS BIGINT) AS total_reps
        FROM workouts WHERE date IS NOT NULL GROUP BY 1, 2""",
    ),
    dates=["month"],
)
def monthly_summary(t: Tables) -> DataFrame:
    return mt.monthly_summary(t.workouts())


@query(
    with_views(
        "workouts",
        """, g AS (SELECT CAST(sum(total_sets) AS DOUBLE) / count(total_sets) AS global_mean FROM workouts)
        SELECT user_id, CAST(sum(total_sets) AS DOUBLE) / count(total_sets) AS user_mean, global_mean,
          CAST(sum(total_sets) AS DOUBLE) / count(total_sets) - global_mean AS difference
        FROM workouts, g GROUP BY user_id, global_mean""",
    )
)
def vs_global_mean(t: Tables) -> DataFrame:
    return mt.vs_global_mean(t.workouts())


_BEFORE = "OVER (PARTITION BY user_id, exercise_title ORDER BY day)"


@query(
    with_views(
        "sets",
        f"""SELECT user_id, exercise_title, day, CAST(w AS DOUBLE) AS max_weight, CAST(v AS DOUBLE) AS volume,
          CAST(w - lag(w) {_BEFORE} AS DOUBLE) AS weight_change,
          CAST(v - lag(v) {_BEFORE} AS DOUBLE) AS volume_change
        FROM (SELECT user_id, exercise_title, CAST(start_time AS DATE) AS day, max(weight_kg) AS w,
          sum(weight_kg * reps) AS v FROM sets GROUP BY 1, 2, 3)""",
    ),
    dates=["day"],
)
def progression(t: Tables) -> DataFrame:
    return mt.progression(t.sets())


@query(with_views("workouts", "SELECT user_id, date, duration_min, total_sets FROM workouts"))
def duration_volume(t: Tables) -> DataFrame:
    return mt.duration_volume(t.workouts())


LAST_SQL = """SELECT user_id, workout_id, strftime(date, '%Y-%m-%d') AS date, exercise_name, muscle_group,
      total_sets, total_reps, weight_kg, rpe,
      CAST(least(count(*) OVER (PARTITION BY user_id), 10)
        - row_number() OVER (PARTITION BY user_id ORDER BY date DESC, workout_id DESC) + 1 AS INTEGER) AS position
    FROM workouts WHERE date IS NOT NULL QUALIFY position >= 1"""


@query(with_views("workouts", LAST_SQL))
def last_rows(t: Tables) -> DataFrame:
    return mt.last_rows(t.workouts().drop("duration_min"), tie_break=["workout_id"])


@query(
    with_views(
        "workouts",
        """SELECT user_id, date, muscle_group, exercise_name, total_sets, total_reps, duration_min,
          weight_kg, rpe FROM workouts ORDER BY date DESC""",
    )
)
def detail_table(t: Tables) -> DataFrame:
    return mt.detail_table(t.workouts())


@query("SELECT event_id, ts, value FROM events ORDER BY ts LIMIT 5")
def preview(t: Tables) -> DataFrame:
    return mt.preview(t.events.select("event_id", "ts", "value").orderBy("ts"), 5)
