"""Tables that grow by commits: exactly-once loads, streams, crashes, compaction."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from trainlake.plans import gold, silver
from trainlake.plans.lake import Lake
from trainlake.schemas import RAW_WORKOUT, WORKOUT_CSV
from trainlake.sources import commits, writers
from trainlake.streaming.batch import ingest_incremental, ingest_new_files
from trainlake.streaming.stream import stream_workouts

DAY = dt.date(2024, 6, 15)


def workout(key, updated="2025-01-01T00:00:00Z", n=1):
    sets = [(i, "normal", 10.0 * (i + 1), 5.0, None, None, None) for i in range(n)]
    return (key, "Leg day", None, None, "2024-01-01T10:00:00Z", "2024-01-01T11:00:00Z", updated, updated, [("Squat", None, None, sets)])


def feed(spark, *keys, updated="2025-01-01T00:00:00Z", user="u"):
    df = spark.createDataFrame([workout(k, updated) for k in keys], RAW_WORKOUT)
    return df if user is None else df.withColumn("user_id", F.lit(user))


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(str(tmp_path / "lake"))
    writers.write_table(spark.createDataFrame([], WORKOUT_CSV), out.bronze("workouts_base"))
    return out


def ids(df, *more):
    return sorted(tuple(r) if more else r[0] for r in df.select("id", *more).collect())


def test_same_day_late_and_repeated_runs(spark, lake):
    raw = lake.bronze("workouts")
    writers.append_batch(feed(spark, "w1"), raw, DAY)
    assert [c.files for c in silver.run_silver_workouts(spark, lake)] == [1]
    writers.append_batch(feed(spark, "w2"), raw, DAY)
    writers.append_batch(feed(spark, "w0", updated="2020-01-01T00:00:00Z"), raw, DAY - dt.timedelta(days=30))
    assert [c.files for c in silver.run_silver_workouts(spark, lake)] == [2]
    assert silver.run_silver_workouts(spark, lake) == []
    assert ids(silver.read_silver_workouts(spark, lake)) == ["w0", "w1", "w2"]


def test_base_counts_once_and_rebuild_replaces(spark, lake):
    base = [(1, "Old", "5 Jan 2024, 07:30", "5 Jan 2024, 08:00", None, "Squat", None, None, 0, "normal", 50.0, 5.0, None, None, 7.0)]
    writers.write_table(spark.createDataFrame(base, WORKOUT_CSV), lake.bronze("workouts_base"))
    raw = lake.bronze("workouts")
    writers.write_table(feed(spark, "base"), f"{raw}/base_full.parquet")
    writers.append_batch(feed(spark, "w1"), raw, DAY)
    for _ in range(2):
        silver.run_silver_workouts(spark, lake)
    writers.append_batch(feed(spark, "w2"), raw, DAY)
    silver.run_silver_workouts(spark, lake, rebuild=True)
    silver.run_silver_workouts(spark, lake)
    got = silver.read_silver_workouts(spark, lake).select("id", "exercise_title").collect()
    assert sorted((r.id or "", r.exercise_title) for r in got) == [("", "Squat"), ("w1", "Squat"), ("w2", "Squat")]


def test_newest_version_over_loads(spark, lake):
    raw = lake.bronze("workouts")
    writers.append_batch(feed(spark, "a", "b", updated="2025-01-01T00:00:00+02:00"), raw, DAY)
    silver.run_silver_workouts(spark, lake)
    writers.append_batch(feed(spark, "a", updated="2024-12-31T23:00:00Z"), raw, DAY)
    silver.run_silver_workouts(spark, lake)
    writers.append_batch(feed(spark, "b", updated="2025-01-01T00:00:00+02:00"), raw, DAY)
    silver.run_silver_workouts(spark, lake)
    assert len(ids(silver.read_silver_workouts(spark, lake))) == 4
    newest = silver.read_silver_workouts(spark, lake, newest_only=True)
    assert ids(newest, "updated_at") == [("a", "2024-12-31T23:00:00Z"), ("b", "2025-01-01T00:00:00+02:00")]
    commits.compact(spark, lake.silver("workouts"), partition_by=["start_month"])
    assert ids(silver.read_silver_workouts(spark, lake, newest_only=True)) == ["a", "b"]


def test_a_load_that_dies_leaves_nothing(spark, lake, monkeypatch):
    raw, dst = lake.bronze("workouts"), lake.silver("workouts")
    writers.append_batch(feed(spark, "w1"), raw, DAY)
    silver.run_silver_workouts(spark, lake)
    writers.append_batch(feed(spark, "w2"), raw, DAY)
    publish = commits._publish

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(commits, "_publish", dies)
    with pytest.raises(OSError):
        silver.run_silver_workouts(spark, lake)
    assert ids(silver.read_silver_workouts(spark, lake)) == ["w1"]
    monkeypatch.setattr(commits, "_publish", publish)
    silver.run_silver_workouts(spark, lake)
    assert ids(silver.read_silver_workouts(spark, lake)) == ["w1", "w2"]
    assert len(commits.read_commits(spark, dst)) == 2


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.commit_rows(spark.range(1), path)
    entry = commits.read_commits(spark, path)[0]
    with pytest.raises(RuntimeError, match="another writer"):
        commits._publish(spark, path, entry)


def test_types_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.commit_rows(spark.range(2), path)
    with pytest.raises(ValueError, match="id is string"):
        commits.commit_rows(spark.range(2).select(F.col("id").cast("string")), path)
    commits.commit_rows(spark.range(2, 3).withColumn("new", F.lit("x")), path)
    commits.commit_rows(spark.range(0).withColumn("other", F.lit(1)), path)
    got = commits.read_committed(spark, path)
    assert got.columns == ["id", "new", "other"]
    assert sorted(tuple(r) for r in got.collect()) == [(0, None, None), (1, None, None), (2, "x", None)]
    with pytest.raises(RuntimeError, match="no commit"):
        commits.read_committed(spark, str(tmp_path / "none"))
    commits.commit_rows(spark.range(0), str(tmp_path / "empty"))
    assert commits.read_committed(spark, str(tmp_path / "empty")).count() == 0


def test_a_named_commit_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.commit_rows(spark.range(2), path, name="s-1").rows == 2
    assert commits.commit_rows(spark.range(2), path, name="s-1") is None
    assert commits.read_committed(spark, path).count() == 2


def test_odd_file_names(spark, tmp_path):
    src, dst = tmp_path / "in", str(tmp_path / "t")
    for k, name in enumerate(("a b", "{x}", "[y]", "50%", "é")):
        writers.write_table(feed(spark, f"w{k}", user=None).coalesce(1), f"{tmp_path}/stage{k}")
        target = src / f"user={name}"
        target.mkdir(parents=True)
        (part,) = [p for p in os.listdir(f"{tmp_path}/stage{k}") if p.endswith(".parquet")]
        os.link(f"{tmp_path}/stage{k}/{part}", target / "x.parquet")
    assert sum(c.rows for c in ingest_new_files(spark, str(src), dst)) == 5
    assert ingest_new_files(spark, str(src), dst) == []
    assert ids(commits.read_committed(spark, dst), "user_id") == [("w0", "a b"), ("w1", "{x}"), ("w2", "[y]"), ("w3", "50%"), ("w4", "é")]


def test_a_file_written_again_is_new(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "t")
    assert ingest_new_files(spark, src, dst) == []
    writers.write_table(feed(spark, "a"), src)
    ingest_new_files(spark, src, dst)
    writers.write_table(feed(spark, "b"), src)
    ingest_new_files(spark, src, dst)
    assert ids(commits.read_committed(spark, dst)) == ["a", "b"]


def test_late_stamp_under_an_earlier_day(spark, tmp_path):
    """A change of 01:30 UTC lands under the local day before that of the mark."""
    state, dst = str(tmp_path / "s"), str(tmp_path / "dst")
    first = feed(spark, "a", updated="2025-12-02T01:00:00Z").withColumn("dt", F.lit(20251202))
    ingest_incremental(spark, first, state, dst, dt.date(2025, 12, 2))
    late = feed(spark, "b", updated="2025-12-02T01:30:00Z").withColumn("dt", F.lit("20251201"))
    ingest_incremental(spark, late, state, dst, dt.date(2025, 12, 2))
    odd = feed(spark, "c", updated="2025-12-02T02:00:00Z").withColumn("dt", F.lit("n/a"))
    ingest_incremental(spark, odd, state, dst, dt.date(2025, 12, 2))
    assert ids(spark.read.parquet(dst)) == ["a", "b", "c"]


def test_stream_and_batch_share_a_table(spark, lake, tmp_path):
    raw, dst = lake.bronze("workouts"), lake.silver("workouts")
    writers.write_table(feed(spark, "a", user=None), f"{raw}/user=u7/dt=20240615")
    stream_workouts(spark, raw, dst, str(tmp_path / "c1")).awaitTermination()
    assert ids(silver.read_silver_workouts(spark, lake), "user_id") == [("a", "u7")]
    writers.append_batch(feed(spark, "b").withColumn("source", F.lit("api")), raw, DAY)
    silver.run_silver_workouts(spark, lake)
    stream_workouts(spark, raw, dst, str(tmp_path / "c1")).awaitTermination()
    stream_workouts(spark, raw, dst, str(tmp_path / "c2")).awaitTermination()
    writers.append_batch(feed(spark, "c").withColumn("source", F.lit("app")), raw, DAY)
    stream_workouts(spark, raw, dst, str(tmp_path / "c2")).awaitTermination()
    got = silver.read_silver_workouts(spark, lake)
    assert ids(got.select("id", "user_id", "source").fillna("-"), "user_id", "source") == [("a", "u7", "-"), ("b", "u", "api"), ("c", "u", "app")]


def test_streamed_silver_feeds_gold(spark, lake, tmp_path):
    raw = lake.bronze("workouts")
    writers.append_batch(feed(spark, "a", "b"), raw, DAY)
    stream_workouts(spark, raw, lake.silver("workouts"), str(tmp_path / "c")).awaitTermination()
    cols = "`Exercise Name` STRING, Main_muscle STRING, Target_Muscles STRING, Synergist_Muscles STRING, Equipment STRING"
    writers.write_snapshot(spark.createDataFrame([("Squat", "Legs", "Quads", None, "Bar")], cols), lake.silver("catalog"), DAY)
    writers.write_table(spark.createDataFrame([(1, "Squat", "Squat")], "sk_exercise LONG, exercise_title_heavy STRING, exercise_name_kaggle STRING"), lake.silver("mapping"))
    gold.run_fact_sets(spark, lake)
    fact = spark.read.parquet(lake.gold("fact_train"))
    assert ids(fact, "user_id", "main_muscle") == [("a", "u", "Legs"), ("b", "u", "Legs")]


def test_compaction(spark, tmp_path):
    """First fit by size; large commits stay as they are; file counts fall and rows stay."""
    path = str(tmp_path / "t")
    big = spark.range(20_000).withColumn("text", F.md5(F.col("id").cast("string")))
    commits.commit_rows(big, path)
    for k in range(6):
        commits.commit_rows(spark.range(k * 10, k * 10 + 10).withColumn("text", F.lit("x")).repartition(3), path)
    before = commits.read_committed(spark, path, loaded_by=True)
    want = before.count(), len(before.inputFiles())
    made = commits.compact(spark, path, target_bytes=200_000, ranged_by=["id"])
    live = [c.name for c in commits.live_commits(commits.read_commits(spark, path))]
    assert len(made) == 1 and live == ["b000000000000", made[0].name] and made[0].rows == 60
    after = commits.read_committed(spark, path, loaded_by=True)
    assert after.count() == want[0] and len(after.inputFiles()) < want[1] - 10
    assert after.select("load_batch").distinct().count() == 7
    assert commits.compact(spark, path, target_bytes=200_000) == []
    assert commits.vacuum(spark, path) == []
    time.sleep(0.01)
    assert len(commits.vacuum(spark, path, dt.timedelta(0))) == 6
    assert commits.read_committed(spark, path).count() == want[0]
    commits.commit_rows(spark.range(1).withColumn("text", F.lit("y")), path, name="b9")
    assert commits.read_committed(spark, path).count() == want[0] + 1


def test_ledger_outlives_compaction(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "t")
    for key in ("a", "b", "c"):
        writers.append_rows(feed(spark, key), src)
        ingest_new_files(spark, src, dst)
    commits.compact(spark, dst)
    commits.vacuum(spark, dst, dt.timedelta(0))
    assert ingest_new_files(spark, src, dst) == []
    assert ids(commits.read_committed(spark, dst)) == ["a", "b", "c"]
