"""Nested workouts to one row per set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.functions.dates import to_utc
from trainlake.functions.values import meters_to_km
from trainlake.schemas import RAW_EXERCISE, RAW_SET, RAW_WORKOUT

# Names that a set's own columns take.
_SET_COLUMNS = {"exercise_title", "exercise_notes", "set_index", "set_type", "distance_km", *RAW_EXERCISE.names, *RAW_SET.names}


def explode_workouts(df: DataFrame, user_id: str | None = None, keep_nested: bool = False, extra: bool = False) -> DataFrame:
    """One row per set of each exercise; workouts without sets give no row.

    ``user_id`` overrides the user of every row; None keeps the column of the input.
    ``keep_nested`` adds a copy of the nested exercises, which repeats the whole workout on
    each of its rows; the raw table has it once, by ``id``. ``extra`` keeps the columns of a
    workout that the declared schema does not know, such as a new field of the feed.
    """
    user = F.col("user_id").cast("string") if user_id is None else F.lit(user_id)
    sets = (
        df.withColumn("_exercise", F.explode("exercises"))
        .filter(F.col("_exercise").isNotNull())
        .withColumn("_set", F.explode("_exercise.sets"))
        .filter(F.col("_set").isNotNull())
    )
    cols = [
        user.alias("user_id"),
        F.col("title"),
        to_utc("start_time").alias("start_time"),
        to_utc("end_time").alias("end_time"),
        F.col("description"),
        F.col("_exercise.title").alias("exercise_title"),
        F.col("_exercise.superset_id").alias("superset_id"),
        F.col("_exercise.notes").alias("exercise_notes"),
        F.col("_set.index").alias("set_index"),
        F.col("_set.type").alias("set_type"),
        F.col("_set.weight_kg").alias("weight_kg"),
        F.col("_set.reps").alias("reps"),
        meters_to_km("_set.distance_meters").alias("distance_km"),
        F.col("_set.duration_seconds").alias("duration_seconds"),
        F.col("_set.rpe").alias("rpe"),
        *[F.col(c) for c in ("id", "routine_id", "updated_at", "created_at")],
    ]
    if keep_nested:
        cols.append(F.col("exercises"))
    if extra:
        known = {"user_id", "exercises", *_SET_COLUMNS, *RAW_WORKOUT.names}
        cols += [F.col(f"`{c}`") for c in df.columns if c not in known]
    return sets.select(*cols)
