"""Context documents of all users."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from trainlake.operators.context import profile_text, summary_text
from trainlake.operators.metrics import (
    HISTORY_MEASURES,
    history_rollup,
    last_rows,
    summary_from_rollup,
    top_categories,
    training_summary,
)
from trainlake.sources.readers import read_table
from trainlake.sources.writers import write_table

# Column of each role in the daily workout table.
DAILY_ROLES = {
    "date": "date",
    "exercise": "exercise_name",
    "muscle": "muscle_group",
    "sets": "total_sets",
    "reps": "total_reps",
    "weight": "weight_kg",
    "rpe": "rpe",
}


def _found(workouts: DataFrame, roles: Mapping[str, str]) -> dict[str, str]:
    return {role: name for role, name in roles.items() if name in workouts.columns}


def summaries_rollup(
    workouts: DataFrame, roles: Mapping[str, str] = DAILY_ROLES, user: str = "user_id"
) -> DataFrame:
    """History figures per user, day, exercise and muscle group."""
    found = _found(workouts, roles)
    keys = [found[r] for r in ("exercise", "muscle") if r in found]
    measures = [found.get(r) for r in HISTORY_MEASURES]
    return history_rollup(workouts, user, found.get("date"), keys, *measures)


def build_summaries(
    workouts: DataFrame,
    roles: Mapping[str, str] = DAILY_ROLES,
    user: str = "user_id",
    tie_break: Sequence[str] = (),
    rollup: DataFrame | None = None,
) -> DataFrame:
    """History text of every user. Columns are named by role, never guessed; lines whose
    columns are absent are left out. Without a date every row counts and no last rows are shown,
    because rows have no order then.

    Pass a written ``summaries_rollup`` to make the figures and both top lists from one
    pass over the workouts.
    """
    found = _found(workouts, roles)
    date = found.get("date")
    dated = workouts if date is None else workouts.filter(workouts[date].isNotNull())
    grouped, rows = (dated, None) if rollup is None else (rollup, "n")
    if rollup is None:
        measures = [found.get(r) for r in HISTORY_MEASURES]
        summary = training_summary(dated, user, date, *measures)
    else:
        summary = summary_from_rollup(rollup, user)
    exercises, muscles = (
        top_categories(grouped, found[r], user=user, rows=rows) if r in found else None
        for r in ("exercise", "muscle")
    )
    cols = list(dict.fromkeys([user, *found.values(), *tie_break]))
    last = None if date is None else last_rows(workouts.select(*cols), user=user, ts=date, tie_break=tie_break)
    return summary_text(summary, exercises, muscles, last, found, user)


def build_context(
    users: DataFrame,
    workouts: DataFrame,
    as_of: Column,
    roles: Mapping[str, str] = DAILY_ROLES,
    user: str = "user_id",
    tie_break: Sequence[str] = (),
    rollup: DataFrame | None = None,
) -> DataFrame:
    """Profile and history text of every user."""
    summaries = build_summaries(workouts, roles, user, tie_break, rollup)
    return profile_text(users, summaries, as_of, user)


def run_context(
    spark: SparkSession,
    users: DataFrame,
    workouts: DataFrame,
    as_of: Column,
    path: str,
    roles: Mapping[str, str] = DAILY_ROLES,
    user: str = "user_id",
    tie_break: Sequence[str] = (),
) -> str:
    """Write the rollup, then the texts from it."""
    root = path.rstrip("/")
    write_table(summaries_rollup(workouts, roles, user), f"{root}/rollup")
    rollup = read_table(spark, f"{root}/rollup")
    texts = build_context(users, workouts, as_of, roles, user, tie_break, rollup)
    write_table(texts, f"{root}/context", sort=[user])
    return f"{root}/context"
