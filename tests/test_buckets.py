"""Bucketed tables: only touched buckets are read and written."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from trainlake.plans import profiles, silver
from trainlake.plans.lake import Lake
from trainlake.sources import buckets as bk
from trainlake.sources import writers

DAY = dt.date(2024, 6, 15)
USERS = "user_id STRING, nome STRING, email STRING, objetivo STRING, peso DOUBLE, created_at STRING"


@pytest.fixture
def lake(spark, tmp_path):
    out = Lake(str(tmp_path / "lake"))
    users = spark.range(200).select(
        F.col("id").cast("string").alias("user_id"),
        F.concat(F.lit("n"), F.col("id")).alias("nome"),
        F.concat(F.lit("n"), F.col("id"), F.lit("@x")).alias("email"),
        F.lit("old").alias("objetivo"),
        F.lit(70.0).alias("peso"),
        F.lit("2024-01-01").alias("created_at"),
    )
    writers.write_snapshot(users, out.gold("users_app"), DAY)
    profiles.create_accounts(spark, out, buckets=16)
    return out


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def changes(spark, *users):
    return spark.createDataFrame([(u, "2025-01-01T00:00:00Z", "new", None) for u in users], "user_id STRING, updated_at STRING, objetivo STRING, peso DOUBLE")


def test_a_change_rewrites_its_buckets_alone(spark, lake):
    path = lake.gold("accounts")
    before = files(path)
    touched = profiles.merge_profile_changes(spark, lake, changes(spark, "7", "8", "nobody"), DAY)
    after = files(path)
    assert len(touched) <= 3 and all(after[f] == t for f, t in before.items())
    new = {f for f in after if f not in before}
    assert new and {f.split("bucket=")[1].split("/")[0] for f in new} <= {str(b) for b in touched}
    got = {r.user_id: (r.objetivo, r.peso) for r in bk.read_buckets(spark, path).collect()}
    assert len(got) == 200 and {u for u, v in got.items() if v == ("new", None)} == {"7", "8"}
    assert sorted(r.user_id for r in spark.read.parquet(lake.bronze("user_form")).collect()) == ["7", "8"]
    # Only folders of touched buckets are in the plan that the merge reads.
    read = bk.read_buckets(spark, path, touched).inputFiles()
    assert read and {f.split("bucket=")[1].split("/")[0] for f in read} == {str(b) for b in touched}


def test_the_key_of_a_change_may_have_another_type(spark, lake):
    whole = spark.createDataFrame([(7, "2025-01-01T00:00:00Z", "new", 1.0)], "user_id LONG, updated_at STRING, objetivo STRING, peso DOUBLE")
    assert len(profiles.merge_profile_changes(spark, lake, whole, DAY)) == 1
    assert bk.read_key(spark, lake.gold("accounts"), "7").first().objetivo == "new"
    assert len(bk.read_key(spark, lake.gold("accounts"), 7).inputFiles()) == 1


def test_nothing_to_do(spark, lake):
    before = files(lake.gold("accounts"))
    assert profiles.merge_profile_changes(spark, lake, changes(spark, "7").limit(0), DAY) == []
    assert files(lake.gold("accounts")) == before


def test_new_accounts(spark, lake):
    new = spark.createDataFrame([("B", " B@x"), ("again", "N7@X"), ("", "c@x"), ("B2", "b@x")], "nome STRING, email STRING")
    assert len(profiles.merge_new_accounts(spark, lake, new, F.lit("now"))) == 1
    assert profiles.merge_new_accounts(spark, lake, new, F.lit("later")) == []
    got = bk.read_buckets(spark, lake.gold("accounts")).filter("created_at <> '2024-01-01'").collect()
    assert [(r.nome, r.email, r.created_at) for r in got] == [("B", "b@x", "now")]


def test_a_merge_that_dies_changes_nothing(spark, lake, monkeypatch):
    path = lake.gold("accounts")

    def dies(*_):
        raise OSError("lost")

    publish = bk.publish
    monkeypatch.setattr(bk, "publish", dies)
    with pytest.raises(OSError):
        profiles.merge_profile_changes(spark, lake, changes(spark, "7"), DAY)
    assert bk.read_buckets(spark, path).filter("objetivo = 'new'").count() == 0
    monkeypatch.setattr(bk, "publish", publish)
    profiles.merge_profile_changes(spark, lake, changes(spark, "7"), DAY)
    assert bk.read_buckets(spark, path).filter("objetivo = 'new'").count() == 1


def test_a_merge_must_keep_rows_in_their_bucket(spark, lake):
    with pytest.raises(ValueError, match="moved rows"):
        bk.merge_buckets(spark, lake.gold("accounts"), changes(spark, "7"), lambda old, _: old.withColumn("user_id", F.concat("user_id", F.lit("x"))))


def test_vacuum_and_empty_buckets(spark, lake):
    path = lake.gold("accounts")
    touched = bk.merge_buckets(spark, path, changes(spark, "7"), lambda old, _: old.limit(0))
    left = bk.read_buckets(spark, path).count()
    assert left < 200 and bk.read_buckets(spark, path, touched).count() == 0
    assert bk.vacuum_buckets(spark, path) == 0
    assert bk.vacuum_buckets(spark, path, dt.timedelta(0)) == 1
    assert bk.read_buckets(spark, path).count() == left
    bk.write_buckets(spark.createDataFrame([("1", 2)], "user_id STRING, x INT"), path, "user_id", 4)
    assert [tuple(r) for r in bk.read_buckets(spark, path).collect()] == [("1", 2)]
    with pytest.raises(RuntimeError, match="no bucketed table"):
        bk.read_buckets(spark, path + "-none")


def test_silver_profiles_by_bucket(spark, lake):
    as_of = F.lit("2024-06-15").cast("timestamp_ntz")
    raw = [(str(k), "2024-01-01", "80", "1.80") for k in range(100)]
    cols = "user_id STRING, data_registro STRING, peso STRING, altura STRING"
    writers.write_table(spark.createDataFrame(raw, cols), lake.bronze("user_profiles") + "/d1")
    assert len(silver.merge_silver_profiles(spark, lake, as_of, buckets=16)) > 10
    assert silver.merge_silver_profiles(spark, lake, as_of) == []
    path = lake.silver("user_profiles_by_bucket")
    before = files(path)
    changed = [*raw[:50], ("50", "2024-02-01", "90", "1.80"), ("new", "2024-02-01", "60", "1.60")]
    writers.write_table(spark.createDataFrame(changed, cols), lake.bronze("user_profiles") + "/d2")
    assert len(silver.merge_silver_profiles(spark, lake, as_of)) <= 2
    assert all(files(path)[f] == t for f, t in before.items())
    got = {r.user_id: r.peso for r in bk.read_buckets(spark, path).collect()}
    assert len(got) == 101 and got["50"] == 90.0 and got["new"] == 60.0 and got["99"] == 80.0
