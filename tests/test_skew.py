"""A key with a third of all rows is split, never handled whole by one task.

The thresholds are lowered so that small tables show what happens to large ones.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from trainlake.operators import joins, metrics, shape
from trainlake.sources.writers import write_table

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@contextmanager
def small_thresholds(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n, parts=12):
    """``n`` rows; key 0 has a third of them, the others have few each."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1)
    return spark.range(0, n, 1, parts).select(key.alias("k"), F.xxhash64("id").alias("v"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_histogram_splits_a_hot_user(spark):
    rows = hot(spark, 300_000).select(F.col("k").alias("user_id"), (F.col("v") % 1_000_000).cast("double").alias("load_kg"))
    with small_thresholds(spark):
        out = metrics.intensity_histogram(rows)
        plan = final_plan(out)
        assert out.agg(F.sum("n")).first()[0] == 300_000
    assert "skewed" in plan


def test_mapping_splits_a_hot_title(spark):
    fact = hot(spark, 300_000).select(F.col("k").cast("string").alias("exercise_title"), "v")
    mapping = spark.range(0, 1000).select(
        F.col("id").cast("string").alias("exercise_title_heavy"),
        F.col("id").cast("string").alias("exercise_name_kaggle"),
        F.col("id").alias("sk_exercise"),
    )
    with small_thresholds(spark):
        out = joins.join_mapping(fact, mapping)
        plan = final_plan(out)
        assert out.count() == 300_000
    assert "skewed" in plan


@pytest.mark.parametrize("null_keys_match", [True, False])
def test_enrichment_splits_a_hot_exercise(spark, null_keys_match):
    fact = hot(spark, 300_000).select(F.col("k").cast("string").alias("exercise_name_kaggle"), "v")
    catalog = spark.range(0, 3000).select(
        (F.col("id") % 1000).cast("string").alias("exercise_name_kaggle"), F.col("id").cast("string").alias("main_muscle")
    )
    with small_thresholds(spark):
        out = joins.enrich_muscles(fact, catalog, null_keys_match)
        plan = final_plan(out)
        assert out.count() == 300_000
    assert "skewed" in plan


def test_account_lookup_splits_a_hot_address(spark):
    asked = hot(spark, 300_000).select(F.concat(F.lit("U"), F.col("k").cast("string")).alias("email"), "v")
    accounts = spark.range(0, 500).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("email"))
    with small_thresholds(spark):
        out = shape.user_ids_for(asked, accounts, default="none")
        plan = final_plan(out)
        assert out.filter("user_id = '0'").count() == 100_000
    assert "skewed" in plan


def test_gold_view_splits_a_hot_exercise(spark):
    exercises = spark.range(0, 1000).select(
        F.col("id").cast("string").alias("exercise_id"),
        F.lit("n").alias("exercise_name"),
        F.lit("e").alias("equipment"),
        F.lit("m").alias("main_muscle"),
    )
    muscles = hot(spark, 300_000).select(F.col("k").cast("string").alias("exercise_id"), F.col("v").cast("string").alias("muscle"))
    steps = spark.createDataFrame([("0", 1, "a"), ("0", 2, "b")], "exercise_id STRING, step_number INT, instruction STRING")
    with small_thresholds(spark):
        out = joins.gold_view(exercises, muscles, steps)
        plan = final_plan(out)
        hot_rows = muscles.filter("exercise_id = '0'").count()
        found = muscles.select("exercise_id").distinct().count()
        assert out.count() == 300_000 + hot_rows + (1000 - found)
    assert "skewed" in plan


def test_hot_folder_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    with small_thresholds(spark):
        write_table(hot(spark, 300_000).withColumn("p", F.col("k") == 0), path, partition_by=["p"], sort=["v"])
    files = [f for f in os.listdir(f"{path}/p=true") if f.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(path).count() == 300_000


@pytest.mark.parametrize("ascending", [True, False])
def test_top_rows_of_a_hot_user(spark, ascending):
    rows = hot(spark, 60_000).select(F.col("k").alias("user_id"), F.timestamp_seconds(F.abs("v") % 1_000_000).cast("timestamp_ntz").alias("date"), "v")
    rows = rows.orderBy("date", ascending=ascending)
    out = metrics.last_rows(rows, n=3, tie_break=["v"]).filter("user_id = 0").orderBy("position")
    want = rows.filter("user_id = 0").orderBy(F.desc("date"), F.desc("v")).limit(3).collect()
    assert [r.v for r in out.collect()] == [r.v for r in reversed(want)]
