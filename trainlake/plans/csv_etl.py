"""Flat CSV feed to a raw and a silver table: one day of one file, or all files that are new."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from trainlake.operators.shape import rename
from trainlake.sources.commits import MAX_FILES, Commit, commit_rows, file_names, loads, new_files, pinned, read_commits, read_load
from trainlake.sources.readers import read_table, read_workout_csv
from trainlake.sources.writers import write_day

SILVER_NAMES = {"title": "workout_title", "exercise_title": "exercise_name"}


def csv_etl(spark: SparkSession, csv_path: str, base: str, day: date, multi_line: bool = False) -> dict[str, str]:
    """Typed scan, raw day, renamed silver day; a second run replaces both. Texts with line ends
    need ``multi_line``; without it a record that they cut ends the run with an error."""
    root = base.rstrip("/")
    raw = write_day(read_workout_csv(spark, csv_path, multi_line), f"{root}/raw/workouts", day)
    silver = write_day(rename(read_table(spark, raw), SILVER_NAMES), f"{root}/silver/workouts", day)
    return {"raw": raw, "silver": silver}


def csv_feed(spark: SparkSession, src: str, base: str, multi_line: bool = True, max_files: int | None = MAX_FILES) -> list[Commit]:
    """Load the CSV files below ``src`` that were not loaded yet, each exactly once, into the raw table
    and then the renamed silver one. A run that ended between the two is made up for: silver gets
    the raw loads that it lacks, under their names. Returns the commits of silver."""
    root = base.rstrip("/")
    raw, silver = f"{root}/raw/workouts_feed", f"{root}/silver/workouts_feed"
    while True:
        files = pinned(new_files(spark, src, raw, "*.csv", most=max_files))
        names = file_names(files)
        if not names:
            break
        commit_rows(read_workout_csv(spark, names, multi_line), raw, files=files)
    known = {c.name for c in read_commits(spark, silver)}
    out = [commit_rows(rename(read_load(spark, raw, name), SILVER_NAMES), silver, name=name) for name in loads(spark, raw) if name not in known]
    return [c for c in out if c is not None]
