"""De-duplication, keys and nested data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkset.registry import query
from checkset.tables import Tables, spelled, with_views
from trainlake.operators import keys as ky
from trainlake.operators.nested import explode_workouts


@query("SELECT DISTINCT p_name, p_type FROM part")
def distinct_rows(t: Tables) -> DataFrame:
    return ky.distinct_rows(t.part.select("p_name", "p_type"))


@query(
    """SELECT p_name, p_type, p_brand, p_partkey FROM part
    QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_type, p_brand, p_partkey) = 1"""
)
def first_per_key(t: Tables) -> DataFrame:
    part = t.part.select("p_name", "p_type", "p_brand", "p_partkey")
    return ky.first_per_key(part, ["p_name"], [F.col("p_type"), F.col("p_brand"), F.col("p_partkey")])


@query(
    """SELECT event_id, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def latest_per_key(t: Tables) -> DataFrame:
    latest = ky.latest_per_key(t.events, "user_id", "ts", tie_break=["event_id"])
    return latest.select("event_id", "user_id", "event_type", "value")


@query(
    """SELECT event_id, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def latest_text_stamps(t: Tables) -> DataFrame:
    """Times as text, in two zones: the later time wins, not the greater text."""
    events = t.events.withColumn("updated_at", spelled("ts", "event_type"))
    latest = ky.latest_per_key(events, "user_id", "updated_at", tie_break=["event_id"])
    return latest.select("event_id", "user_id", "event_type", "value")


@query(
    with_views(
        "workouts",
        """SELECT workout_id, user_id, date FROM workouts QUALIFY row_number() OVER
        (PARTITION BY user_id ORDER BY date DESC NULLS FIRST, workout_id DESC) = 1""",
    )
)
def latest_null_wins(t: Tables) -> DataFrame:
    latest = ky.latest_per_key(t.workouts(), "user_id", "date", nulls="win", tie_break=["workout_id"])
    return latest.select("workout_id", "user_id", "date")


@query(
    """SELECT row_number() OVER (ORDER BY p_name, p_type, p_brand) AS sk_exercise, p_name, p_type, p_brand
    FROM (SELECT DISTINCT p_name, p_type, p_brand FROM part)"""
)
def surrogate_key(t: Tables) -> DataFrame:
    names = t.part.select("p_name", "p_type", "p_brand").distinct()
    return ky.surrogate_key(names, "sk_exercise", ["p_name", "p_type", "p_brand"])


@query(
    """SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS VARCHAR)
      AS user_id, l_orderkey, l_linenumber, l_extendedprice FROM lineitem"""
)
def position_id(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ky.ensure_id(lines, "user_id", order=lines.columns, alt="id")


@query(
    with_views(
        "nested",
        """SELECT user_id, title, start_time, end_time, description, exercise_title, superset_id,
          exercise_notes, set_index, set_type, weight_kg, reps, distance_km, duration_seconds, rpe,
          id, routine_id, updated_at, created_at FROM nested""",
    )
)
def explode_sets(t: Tables) -> DataFrame:
    return explode_workouts(t.landed_nested(), keep_nested=False)
