"""Dashboard tables of all users."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from trainlake.functions.dates import with_calendar
from trainlake.operators import metrics as m
from trainlake.operators.shape import drop_null, resolve_column
from trainlake.sources.readers import read_table
from trainlake.sources.writers import write_table

USER = "user_id"


def tables_from_rollup(rollup: DataFrame) -> dict[str, DataFrame]:
    """The tables that need only rows, sums and counts per user, day and muscle group; those
    whose columns are absent are left out."""
    found = set(rollup.columns)
    out = {"kpis": m.kpis_from_rollup(rollup)}
    if "day" in found:
        out["weekly"] = m.weekly_frequency(rollup, ts="day", rows="n_rows")
    if {"day", "total_sets"} <= found:
        out["daily"] = m.rolling_mean(m.daily_sets(rollup, ts="day"))
    if {"muscle_group", "total_sets"} <= found:
        out["muscle_share"] = m.muscle_share(rollup)
    if {"day", "muscle_group", "total_sets"} <= found:
        out["dow_muscle"] = m.dow_muscle_matrix(rollup, ts="day")
    return out


def tables_from_rows(workouts: DataFrame) -> dict[str, DataFrame]:
    """The tables that need the workouts; those whose columns are absent are left out."""
    found = set(workouts.columns)
    out = {"detail": m.detail_table(with_calendar(workouts) if "date" in found else workouts)}
    if {"exercise_name", "total_sets"} <= found:
        out["exercise_ranking"] = m.exercise_ranking(workouts)
    if resolve_column(workouts, m.INTENSITY_COLUMNS, contains=False):
        out["intensity"] = m.intensity_histogram(workouts)
    if {"duration_min", "total_sets"} <= found:
        out["duration_volume"] = m.duration_volume(workouts)
    return out


def build_dashboard(workouts: DataFrame, rollup: DataFrame | None = None) -> dict[str, DataFrame]:
    """All dashboard tables, lazily. Pass a written ``rollup`` to share its one pass."""
    dated = drop_null(workouts, ["date"]) if "date" in workouts.columns else workouts
    if rollup is None:
        rollup = m.activity_rollup(dated)
    return {**tables_from_rollup(rollup), **tables_from_rows(dated)}


def run_dashboard(spark: SparkSession, workouts: DataFrame, path: str) -> Mapping[str, str]:
    """Write the rollup first, then every table from it or from the workouts, by user: a page
    reads the few files that hold its user."""
    root = path.rstrip("/")
    write_table(m.activity_rollup(workouts), f"{root}/rollup", sort=[USER])
    tables = build_dashboard(workouts, read_table(spark, f"{root}/rollup"))
    paths = {name: f"{root}/{name}" for name in tables}
    for name, table in tables.items():
        # The detail table comes dealt and sorted by user already.
        write_table(table, paths[name], sort=() if name == "detail" else [USER])
    return paths
