"""Partial states: any split of the rows gives the figures of all rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trainlake.operators import metrics, states
from trainlake.plans import incremental
from trainlake.sources import commits

COLUMNS = "workout_id INT, user_id STRING, date TIMESTAMP_NTZ, muscle_group STRING, total_sets INT, total_reps INT, duration_min INT, weight_kg DOUBLE, rpe DOUBLE"


def workouts(spark, n=400):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        day = dt.datetime(2023, 12, 20) + dt.timedelta(hours=rng.randrange(24 * 400))
        rows.append((k, rng.choice(["hot", "hot", "a", "b", None]), day if rng.random() > 0.05 else None, rng.choice(["legs", None]), rng.choice([None, 1, 5]), rng.randrange(9), 30, rng.randrange(40) / 4, None))
    return spark.createDataFrame(rows, COLUMNS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_states_add_up(spark):
    df = workouts(spark).persist()
    parts = [df.filter(F.pmod("workout_id", F.lit(3)) == k) for k in range(3)]
    activity = states.merge_states(parts[2].transform(states.activity_state).unionByName(parts[0].transform(states.activity_state)).unionByName(parts[1].transform(states.activity_state)))
    assert rows(states.kpis_from_state(activity)) == rows(metrics.user_kpis(df))
    history = states.merge_states(parts[0].transform(states.history_state).unionByName(parts[1].unionByName(parts[2]).transform(states.history_state)))
    want = metrics.training_summary(df)
    assert rows(states.summary_from_state(history).select(*want.columns)) == rows(want)
    assert states.mark_from_state(activity).first()[0] == df.agg(F.max("date")).first()[0] == states.mark_from_state(history).first()[0]


def test_each_load_counts_once(spark, tmp_path):
    df, src, base = workouts(spark), str(tmp_path / "src"), str(tmp_path / "gold")
    for k in range(3):
        commits.commit_rows(df.filter(F.pmod("workout_id", F.lit(3)) == k), src)
        got = incremental.update_kpis(spark, src, base)
        assert incremental.update_state(spark, src, f"{base}/activity_state", states.activity_state) == []
    assert rows(got) == rows(metrics.user_kpis(df))
    # A compacted source brings nothing new, and what it had before is found in it.
    commits.compact(spark, src)
    assert rows(incremental.update_kpis(spark, src, base)) == rows(metrics.user_kpis(df))
    assert rows(incremental.update_kpis(spark, src, str(tmp_path / "other"))) == rows(metrics.user_kpis(df))


def test_a_load_reads_its_own_files(spark, tmp_path, monkeypatch):
    df, src, base = workouts(spark), str(tmp_path / "src"), str(tmp_path / "gold")
    commits.commit_rows(df.filter("workout_id < 300"), src)
    incremental.update_kpis(spark, src, base)
    commits.commit_rows(df.filter("workout_id >= 300"), src)
    last = commits.loads(spark, src)[-1]
    files = commits.read_load(spark, src, last).inputFiles()
    assert files and all(f"commit={last}" in f for f in files)


def test_compacted_state_and_rebuild(spark, tmp_path):
    df, src, base = workouts(spark), str(tmp_path / "src"), str(tmp_path / "gold")
    place = f"{base}/activity_state"
    for k in range(2):
        commits.commit_rows(df.filter(F.pmod("workout_id", F.lit(2)) == k), src)
        incremental.update_kpis(spark, src, base)
    want = rows(metrics.user_kpis(df))
    assert incremental.compact_state(spark, place, ("user_id", "week"))
    assert not incremental.compact_state(spark, place, ("user_id", "week"))
    assert rows(incremental.update_kpis(spark, src, base)) == want
    # A workout comes again: the rebuild takes the rows that count, later loads are added.
    commits.commit_rows(df.filter("workout_id < 50"), src)
    incremental.update_state(spark, src, place, states.activity_state, rebuild=lambda: commits.read_committed(spark, src).distinct())
    assert rows(incremental.update_kpis(spark, src, base)) == want
    commits.commit_rows(df.filter("workout_id < 7").withColumn("user_id", F.lit("new")), src)
    more = df.unionByName(df.filter("workout_id < 7").withColumn("user_id", F.lit("new")))
    assert rows(incremental.update_kpis(spark, src, base)) == rows(metrics.user_kpis(more))


@pytest.mark.parametrize("table", ["kpis", "weekly", "daily", "muscle_share", "dow_muscle"])
def test_dashboard(spark, tmp_path, table):
    from trainlake.plans import dashboard
    from trainlake.sources.readers import read_table

    df, src, base = workouts(spark, 120), str(tmp_path / "src"), str(tmp_path / "gold")
    for k in range(2):
        commits.commit_rows(df.filter(F.pmod("workout_id", F.lit(2)) == k), src)
        paths = incremental.update_dashboard(spark, src, base)
    want = dashboard.tables_from_rollup(metrics.activity_rollup(df))[table]
    assert rows(read_table(spark, paths[table]).select(*want.columns)) == rows(want)
